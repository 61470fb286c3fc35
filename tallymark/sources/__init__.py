"""Sources and sinks as DataFrames."""
