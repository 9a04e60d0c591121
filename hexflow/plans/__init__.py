"""Whole queries, composed of operators, and their SQL."""
