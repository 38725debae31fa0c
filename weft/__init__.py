"""weft: evidence-scored property-graph analytics on Spark DataFrames."""
