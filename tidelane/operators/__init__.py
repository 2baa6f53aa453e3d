"""Lane, log, replay, verification and span operators on DataFrames."""
