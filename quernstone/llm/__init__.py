"""Operators for preparing language-model training data, one module each, and the queries that apply them."""
