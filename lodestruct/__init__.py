"""Structure analytics on Spark: three-level datasets, neighbour joins, segmented aggregates, metrics and monitors."""
