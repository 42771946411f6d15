"""Composed jobs over the input tables, and the named-query catalog."""
