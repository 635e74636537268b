"""Operators for preparing training corpora at scale.

Every operator takes and returns DataFrames; nothing else in the library
imports this subpackage. ``queries.py`` registers one query per operator.
"""
