"""Spark-first document ingestion, retrieval and corpus preparation."""
