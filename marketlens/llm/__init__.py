"""Operators for preparing training text: encoding, deduplication, scoring, filtering and packing.

Nothing outside this subpackage imports it.
"""
