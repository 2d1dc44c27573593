"""Spark-native analytics over corpora of technical documents."""
