"""Spark-native analytics over code facts, findings and training corpora."""
