"""Whole jobs: prompts, backends, matching with retries, evaluation."""
