"""Spark-native audit of public election records."""
