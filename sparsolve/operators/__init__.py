"""Linear algebra as joins, projections and aggregations."""
