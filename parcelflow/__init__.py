"""Spark-native plan-sheet analytics."""
