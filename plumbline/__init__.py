"""Spark-native analytics for measured spaces and the evidence around them."""
