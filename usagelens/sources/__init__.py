"""Readers for raw logs and side files, and the report tables."""
