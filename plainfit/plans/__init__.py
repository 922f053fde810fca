"""The moment jobs that fits are solved from."""
