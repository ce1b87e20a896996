"""Spark-first corpus processing: operators are functions from DataFrame (or Column) to DataFrame (or Column)."""
