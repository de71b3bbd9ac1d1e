"""Corpus preparation on Spark: DataFrame in, DataFrame out."""
