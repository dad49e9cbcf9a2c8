"""Operators for training-data pipelines, one module each, with their queries in `queries.py`.

Nothing else in the package imports this subpackage.
"""
