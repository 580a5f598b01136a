"""Operators for preparing text corpora and vectors at scale."""
