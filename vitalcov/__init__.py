"""Completeness of vital registration, as Spark DataFrame operators."""
