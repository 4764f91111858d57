"""Readers and writers of spectrum and search-result files."""
