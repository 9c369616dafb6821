"""Operators for training-data corpora and the queries registered for them."""
