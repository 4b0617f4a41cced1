"""Readers of stories, recalls and benchmarks; writers of results."""
