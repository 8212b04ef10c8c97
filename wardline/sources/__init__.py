"""Readers, sinks, contracts and session defaults."""
