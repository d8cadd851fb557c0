"""Operators of a training-data pipeline, as Spark jobs over a ``documents`` table.

Each module holds one operator with its own general interface; ``queries`` binds them to
the tables of the test data. Nothing else in the package imports this subpackage.
"""
