"""Relational operators over records and logs."""
