"""Operators of a training-data pipeline: scoring, filters, joins, mixing and token files.

Nothing outside this subpackage imports it.
"""
