"""Veldt: relational and vector analytics on PySpark DataFrames."""
