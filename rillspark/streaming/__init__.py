"""Streaming forms: sinks, stateful processors and windowed queries under Structured Streaming."""
