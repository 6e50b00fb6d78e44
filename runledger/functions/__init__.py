"""Column-level building blocks; every one runs as part of a DataFrame job."""
