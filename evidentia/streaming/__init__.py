"""Streaming twins of keyed state machines and event-time windows."""
