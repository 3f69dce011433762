"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  ``registry`` holds its queries
and their SQL; every other module is one operator with an interface of its own.
"""
