"""Text-corpus analytics on Spark: DataFrames in, DataFrames out."""
