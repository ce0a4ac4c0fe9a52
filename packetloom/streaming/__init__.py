"""Structured Streaming forms of the detections."""
