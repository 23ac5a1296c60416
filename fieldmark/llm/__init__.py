"""Operators of a training-data pipeline: one module per operator, queries and SQL in ``queries``
and ``oracles``. Nothing else in the library imports this subpackage."""
