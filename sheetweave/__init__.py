"""Drawing-graph analytics as keyed Spark DataFrames."""
