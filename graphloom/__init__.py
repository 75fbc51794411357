"""graphloom: property-graph, bibliometric and record analytics on Spark DataFrames."""
