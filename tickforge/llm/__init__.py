"""Operators that a large training-data pipeline needs, one module each.

Nothing else in the library imports this subpackage. ``queries`` holds the thin
``opN_<name>`` queries and their SQL; the operators keep general interfaces.
"""
