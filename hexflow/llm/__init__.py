"""Training-data operators: the corpus operations that run as Spark jobs.

Nothing else in the library imports this subpackage.
"""
