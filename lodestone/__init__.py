"""Spark-native code-intelligence analytics."""
