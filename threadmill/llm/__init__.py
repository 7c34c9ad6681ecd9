"""Operators for large training-data pipelines.

Nothing outside this package imports it; deleting the folder leaves the rest of
the engine working.
"""
