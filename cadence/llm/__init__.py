"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. ``queries.py`` holds the
registered queries; every other module is one operator or a shared helper.
"""
