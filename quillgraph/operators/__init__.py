"""Operators from documents to graph to answers."""
