"""Keeping derived tables up to date with Structured Streaming."""

from rivulet.streaming.refresh import refresh_index, refresh_view, tumble

__all__ = ["refresh_index", "refresh_view", "tumble"]
