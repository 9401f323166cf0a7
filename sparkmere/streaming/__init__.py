"""Resumable sinks on Structured Streaming."""
