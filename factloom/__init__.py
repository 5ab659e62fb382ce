"""factloom: evidence-backed entity-graph analytics on Spark DataFrames."""
