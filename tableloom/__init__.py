"""Tabular analytics and machine learning as Spark DataFrame operators."""
