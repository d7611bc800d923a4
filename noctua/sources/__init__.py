"""Sources and sinks: fixture views, table I/O, snapshots, validation."""
