"""loomlake: text knowledge bases as Spark DataFrames."""
