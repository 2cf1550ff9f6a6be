"""Incremental review of files that arrive."""
