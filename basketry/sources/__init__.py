"""Feeds, landing, star tables and sinks."""
