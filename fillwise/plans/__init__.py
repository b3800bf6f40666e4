"""Compositions of operators: one object for all questions, and the data behind each dashboard page."""
