"""Structured Streaming counterparts: an extension, as the reference behaviour has no streams."""
