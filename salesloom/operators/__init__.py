"""Table operators: every one takes DataFrames and returns lazy DataFrames."""
