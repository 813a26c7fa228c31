"""Keyed lake-table ingestion on PySpark: notifications and files in, versioned tables out."""
