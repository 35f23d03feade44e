"""Drawing extraction, scoring and corpus preparation on Spark DataFrames."""
