"""Sources and sinks: files, catalogs, caches and event logs."""
