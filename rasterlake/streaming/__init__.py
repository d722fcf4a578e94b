"""Structured Streaming forms of the job and rate-limit operators."""
