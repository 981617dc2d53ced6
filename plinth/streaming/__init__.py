"""Structured Streaming forms of the operators that run again and again."""
