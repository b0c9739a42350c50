"""netloom: graph-ensemble analytics and training-data operators on Spark DataFrames."""
