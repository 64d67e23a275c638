"""Reading raw files: drifting CSV, nested JSON, strict batch reads, tables as streams."""
