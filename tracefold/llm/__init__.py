"""Operators for large training-text pipelines.

Nothing else in the library imports this subpackage; ``queries`` holds the
thin queries the entry module registers.
"""
