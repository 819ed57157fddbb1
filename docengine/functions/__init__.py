"""Pure column functions. No Python runs per row."""
