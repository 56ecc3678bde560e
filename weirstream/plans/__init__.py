"""Rewriting of streaming-SQL idioms."""
