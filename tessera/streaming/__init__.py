"""Incremental runs over growing folders."""
