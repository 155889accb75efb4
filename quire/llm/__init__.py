"""Operators of a training-data pipeline over documents, vectors and pages.

Nothing else in the library imports this package. Each module holds one operator with its own interface;
``queries`` registers the thin queries and the SQL of those that SQL can express.
"""
