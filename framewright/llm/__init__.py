"""Training-data pipeline operators: one module per operator, plus the queries that apply them.

Nothing outside this subpackage imports it, so the rest of the library works without it.
"""
