"""wiretally: wire-level service telemetry as DataFrames."""
