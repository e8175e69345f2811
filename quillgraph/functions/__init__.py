"""Columns for text, numbers and validity."""
