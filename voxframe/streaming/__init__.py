"""Structured Streaming: resumable block processing and online metrics."""
