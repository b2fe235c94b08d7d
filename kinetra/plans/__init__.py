"""Registered queries: DataFrame plans over the given tables, and their SQL."""
