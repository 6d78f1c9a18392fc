"""Spark-native analytics for curated, labelled text corpora."""
