"""Timeline analytics on Spark DataFrames: intervals, series, tokens and constrained ranking."""
