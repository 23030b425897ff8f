"""Operators for preparing language-model training data.

Nothing outside this package imports it. Every operator takes DataFrames and
parameters; ``queries.py`` holds the thin ``opN_<name>`` queries.
"""
