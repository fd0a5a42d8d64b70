"""Table replication and change-data operators for PySpark."""
