"""Incremental runs of operators over growing folders."""
