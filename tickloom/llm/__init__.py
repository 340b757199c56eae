"""Operators of a training-data pipeline over text, URL, chat and vector tables.

Nothing else in the package imports this one.
"""
