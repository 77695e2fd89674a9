"""Site selection and evidence retrieval on Spark DataFrames."""
