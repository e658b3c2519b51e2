"""Operators that prepare text and vectors for model training, each with its own named query."""
