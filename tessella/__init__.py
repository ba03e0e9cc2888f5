"""Spark-native retrieval analytics: predicates, search, ranking, chunking, graphs."""
