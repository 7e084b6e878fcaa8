"""Named analytics queries on Parquet tables, written for PySpark."""
