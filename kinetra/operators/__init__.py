"""Operators on whole DataFrames; each returns a lazy DataFrame unless it says otherwise."""
