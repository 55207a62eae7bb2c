"""Sources (scans, catalog, adapter views) and sinks."""
