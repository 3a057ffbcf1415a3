"""Structured Streaming: a watch over folders."""
