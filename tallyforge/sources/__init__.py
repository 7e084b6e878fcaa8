from tallyforge.sources.tables import MissingColumns, ParquetTables

__all__ = ["MissingColumns", "ParquetTables"]
