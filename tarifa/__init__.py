"""Spark-native governance analytics for pricing models."""
