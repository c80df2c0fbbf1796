"""Spark-native analytics over the usage logs of coding agents."""
