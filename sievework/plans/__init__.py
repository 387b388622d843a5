"""Operators put together: transform a source, load core tables, run QA, correct, report."""
