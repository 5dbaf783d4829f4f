"""Analysis, compilation of rules to DataFrames, and fixpoints."""
