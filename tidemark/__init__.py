"""Spark-native time-series analytics and forecasting."""
