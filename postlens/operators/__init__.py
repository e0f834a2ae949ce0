"""DataFrame operators: each takes and returns DataFrames (keys are explicit)."""
