"""Spark-first analytics engine for cross-sectional time series."""
