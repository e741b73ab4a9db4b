"""Scans of source folders and the incremental cache tables."""
