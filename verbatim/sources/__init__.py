"""Readers for responses, stop words and lexicons."""
