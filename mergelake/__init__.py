"""Spark-native change-data engine: last-writer-wins merge of column-level change records, on DataFrames."""
