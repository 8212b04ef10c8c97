"""DataFrame operators. Each takes DataFrames and returns a DataFrame without running a job."""
