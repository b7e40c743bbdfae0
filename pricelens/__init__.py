"""Spark-native calibration analytics for event-contract trade data."""
