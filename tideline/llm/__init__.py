"""Operators of a training-data pipeline over documents and web addresses.

Each module holds one operator with its own interface; ``queries`` applies them to whole tables.
"""
