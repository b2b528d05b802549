"""Checked queries: the operators over the given tables, with plain SQL beside them."""
