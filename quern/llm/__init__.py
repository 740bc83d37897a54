"""Training-data pipeline operators: the ten components and their queries.

Nothing else in the library imports this subpackage.
"""
