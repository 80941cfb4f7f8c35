"""Operators of a training-data pipeline, as Spark jobs (see the modules' docstrings).

Nothing else in the library imports this package.
"""
