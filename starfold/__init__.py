"""Star-schema aggregation on Spark: one declarative plan, several physical strategies."""
