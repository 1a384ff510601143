"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; every operator takes and returns
DataFrames and keeps per-row Python to small vectorised helpers.
"""
