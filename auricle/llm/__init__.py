"""Operators for preparing text and records of training corpora; nothing else in the library imports them."""
