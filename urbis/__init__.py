"""Analytics over semantic 3D city models on Spark DataFrames."""
