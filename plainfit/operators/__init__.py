"""DataFrame operators: preparation, aggregation, ranking, boards, tests and linear models."""
