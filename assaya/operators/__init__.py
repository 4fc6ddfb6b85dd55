"""DataFrame operators: joins, aggregations, windows and verdicts."""
