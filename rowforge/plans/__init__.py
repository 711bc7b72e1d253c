"""Predicates: text to syntax tree, syntax tree to Columns."""
