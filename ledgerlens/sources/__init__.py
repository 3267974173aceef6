"""Sources: parquet tables, typed line adapters, sheet grids, file listings."""
