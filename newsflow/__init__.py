"""newsflow: monitoring of text sources and digest compilation on Spark DataFrames."""
