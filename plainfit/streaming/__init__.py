"""Scoring of streams with compiled models."""
