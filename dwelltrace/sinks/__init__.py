"""Writers: flat tables as Parquet or CSV, event logs as JSON lines."""
