"""Market-analytics operators for PySpark: functions from DataFrames to a DataFrame."""
