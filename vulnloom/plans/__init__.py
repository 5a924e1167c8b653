"""Whole scans put together from operators."""
