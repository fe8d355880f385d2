"""Readers, writers and the Python data source."""
