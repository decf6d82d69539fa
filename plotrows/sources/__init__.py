"""Sources and sinks: scans return DataFrames, sinks write them."""
