"""Structured Streaming form of the pipeline."""
