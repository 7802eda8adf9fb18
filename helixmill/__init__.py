"""helixmill: alignment quality control and fragmentomics on Spark DataFrames."""
