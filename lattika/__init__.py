"""Spark-native analytics over gridded numeric data, timelines and keyed streams."""
