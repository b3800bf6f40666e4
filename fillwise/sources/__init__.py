"""Readers and writers: files in, analytic tables out, and back."""
