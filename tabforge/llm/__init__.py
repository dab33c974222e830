"""Operators of a training-data pipeline: packing, chat formatting, scoring, deduplication, mixing.

Nothing else in the library imports this subpackage. ``queries.QUERIES`` holds the registered
queries, one thin function per operator.
"""
