"""lexivane: text search, ranking, recommendation and evaluation on Spark DataFrames."""
