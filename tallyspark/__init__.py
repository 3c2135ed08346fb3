"""Spark-native engine for financial-transaction data: ingest, clean, de-duplicate, match and report."""
