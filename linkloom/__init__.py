"""Link-graph analytics and text processing on Spark DataFrames."""
