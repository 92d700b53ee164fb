"""Structured Streaming jobs: incremental refresh and last-filed state."""
