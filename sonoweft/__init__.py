"""Speech-alignment analytics on Spark: corpora, features, statistics, models and intervals as DataFrames."""
