"""Structured Streaming twins of the single-pass folds."""
