"""Operators that prepare texts for training. Nothing outside this package imports it."""
