"""Spark-native analytics for multichannel time-series studies."""
