"""Sources and sinks: test tables, lake, landed payloads."""
