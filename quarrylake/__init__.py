"""Spark-first document analytics: ingest, deduplicate, check, index, retrieve and evaluate."""
