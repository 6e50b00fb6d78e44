"""Jobs over tables: DataFrames in, DataFrames out."""
