"""Operators for preparing large text corpora (see README, "Corpus operators").

Nothing outside this package imports it.
"""
