"""Spark-native retrieval and corpus analytics over bilingual document collections."""
