"""Spark-native table standardisation, enrichment, search and reconciliation."""
