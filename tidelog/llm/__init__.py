"""Training-data operators: counting, formatting, encoding, scoring, deduplicating.

Nothing else in the library imports this subpackage.
"""
