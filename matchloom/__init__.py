"""matchloom: schema, result and record comparison on Spark DataFrames."""
