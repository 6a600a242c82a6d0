"""Structured Streaming forms of the recording and judging operators."""
