"""Readable regression, statistical evidence and leaderboards on Spark DataFrames."""
