"""Structured Streaming over execution logs."""
