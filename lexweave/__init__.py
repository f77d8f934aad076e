"""Spark-native text retrieval, index analytics and corpus processing."""
