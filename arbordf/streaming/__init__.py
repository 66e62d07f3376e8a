"""Streaming forms of operators; an addition of this library."""
