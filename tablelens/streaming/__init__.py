"""Structured Streaming: profiles of arriving files."""
