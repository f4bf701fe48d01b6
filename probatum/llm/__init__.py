"""Operators of a training-data pipeline.

Every operator takes a frame of documents, names its columns by parameters and returns
one row per input row (or what its docstring says).  Nothing else in the library imports
this subpackage.
"""
