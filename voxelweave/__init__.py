"""Spark-native engine for labelled-array and time-series analytics."""
