"""Operators for preparing large text corpora, built on Spark DataFrames.

Nothing else in ``tessella`` imports this subpackage.
"""
