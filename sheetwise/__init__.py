"""Spark-native drawing-graph analytics."""
