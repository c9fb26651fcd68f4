"""Spark-native operators over pixel tables: detection, modelling and measurement."""
