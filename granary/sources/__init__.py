"""Where rows come from and go: versioned Parquet storage, CSV, scripts, copies."""
