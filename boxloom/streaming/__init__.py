"""Scoring and tracking, batch and Structured Streaming."""
