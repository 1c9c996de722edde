"""Structured Streaming: files that arrive, and job state kept from updates."""
