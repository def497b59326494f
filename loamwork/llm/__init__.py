"""Operators for building language-model training corpora as Spark jobs.

Nothing else in the library imports this subpackage.
"""
