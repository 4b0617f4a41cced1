"""Incremental runs that resume where they were stopped."""
