"""Streaming placement against a static reference."""
