"""Spark-native record analytics: DataFrame-to-DataFrame operators with explicit clocks."""
