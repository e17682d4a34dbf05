"""Player analytics on Spark: sources, cleaning, metrics, peer groups, models, queries."""
