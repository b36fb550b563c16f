"""The jobs bound to the driver's tables, and the same answers in plain SQL for DuckDB."""
