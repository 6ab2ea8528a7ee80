"""Readers and writers for JSON, CSV, Parquet and catalog tables."""
