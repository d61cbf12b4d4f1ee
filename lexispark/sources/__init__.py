"""Files and datasets read as DataFrames, and DataFrames written as files."""
