"""Operators for text corpora and evaluation data. Nothing outside this subpackage imports it."""
