"""docengine: document understanding at corpus scale, as DataFrame operations."""
