"""motifspark: frequent-subgraph mining and subgraph matching on Spark DataFrames."""
