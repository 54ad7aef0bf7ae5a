"""Operators for large training corpora: one module per operator, `queries` binds them to tables."""
