"""parley: conversation analytics and corpus preparation on Spark DataFrames."""
