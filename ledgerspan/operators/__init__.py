"""Statement operators: pure functions from DataFrames to DataFrames, every key led by `cik`."""
