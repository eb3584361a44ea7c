"""Spark-native slide analytics."""
