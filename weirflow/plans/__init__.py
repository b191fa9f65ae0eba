"""Pipelines as graphs of lazy frames, and how they run."""
