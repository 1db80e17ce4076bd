"""The analyses, one module per topic. Each is a function from DataFrames to a DataFrame."""
