"""Operators that prepare text and records for training; nothing else in the library needs them."""
