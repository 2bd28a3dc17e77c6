"""Spark-native analytics over e-commerce persuasion patterns."""
