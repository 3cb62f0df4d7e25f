"""Spark-native photo-location analytics: clustering, sun fit, retrieval, re-ranking and event analytics."""
