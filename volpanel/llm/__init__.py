"""Operators of a training-data pipeline: one module each, queries and SQL checks in ``queries``."""
