"""Versioned Parquet tables and large-scale record processing on plain PySpark."""
