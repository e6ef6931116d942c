"""Spark-native tabular analytics and feature engineering."""
