"""A PySpark-native engine for exact K-means clustering analytics."""
