"""Spark-native analytics for cohorts of overnight recordings."""

__version__ = "0.1.0"
