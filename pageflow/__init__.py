"""Document-image, recognition and training-data analytics on Spark DataFrames."""
