"""Readers: files in, one tidy row per record out."""
