"""Spark-native analytics over a store of text records, vectors, relations and events."""
