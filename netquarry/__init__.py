"""Spark-native analytics over property graphs of hardware design artifacts."""
