"""Scans, adapter views, catalog readers and sinks."""
