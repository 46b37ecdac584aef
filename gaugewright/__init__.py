"""Gaugewright: a Spark-native quality engine for sensor networks and text corpora."""
