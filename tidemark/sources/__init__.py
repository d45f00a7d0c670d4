"""Readers, sinks and the canonical views that queries share."""
