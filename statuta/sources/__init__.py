"""Sources and sinks of the library."""
