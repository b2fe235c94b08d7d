"""Operators for corpora and models. Nothing outside this subpackage imports it."""
