"""Spark-native code index and training-data operators."""
