"""Versioned keyed tables, SQL over snapshots and training-data operators on PySpark."""
