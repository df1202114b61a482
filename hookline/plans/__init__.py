"""Compositions of operators and the query catalog."""
