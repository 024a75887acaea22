"""Piped analytics on PySpark: every operator is a function from DataFrame to DataFrame."""
