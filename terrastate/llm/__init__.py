"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame and reads only the columns it names, so other columns may have any
name.  ``queries`` holds the thin registered queries.
"""
