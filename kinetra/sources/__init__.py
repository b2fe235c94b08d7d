"""Readers and writers of the measurement formats."""
