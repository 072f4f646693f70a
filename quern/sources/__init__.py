"""Sources and sinks. Small heads, listings and reports pass the driver; data does not."""
