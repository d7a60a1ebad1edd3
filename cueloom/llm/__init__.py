"""Operators for preparing large text corpora: one module per operator.

Nothing outside this package imports it.
"""
