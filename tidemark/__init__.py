"""tidemark: catalogs that change over time, as Spark DataFrames."""
