"""Operators that prepare text for training corpora. Nothing else in the library imports this."""
