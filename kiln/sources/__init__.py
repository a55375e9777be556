from kiln.sources.tables import TABLE_NAMES, Tables, read_table

__all__ = ["TABLE_NAMES", "Tables", "read_table"]
