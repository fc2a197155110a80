"""Document-layout analytics and translation pipelines as Spark DataFrames."""
