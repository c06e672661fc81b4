"""Readers: bytes or files to rows."""
