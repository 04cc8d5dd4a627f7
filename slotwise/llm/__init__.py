"""Operators that prepare text collections for training; nothing else in this library imports them."""
