"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  `queries.QUERIES` and
`queries.ORACLE_SQL` are what `__spark_entry__.py` picks up.
"""
