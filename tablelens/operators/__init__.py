"""Profile operators: DataFrame in, DataFrame out, lazy."""
