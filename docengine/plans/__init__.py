"""Composed plans: presets, the document pipeline and the query catalogue."""
