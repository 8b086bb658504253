"""Structured Streaming: discovery over a growing snapshot, and politeness state for each host."""
