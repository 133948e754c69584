"""DataFrame operators: joins, de-duplication, ranking, aggregation."""
