"""Scoring of free-text location answers and geographic image sampling, as plain Spark DataFrame functions."""
