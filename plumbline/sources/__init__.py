"""Scans: source lists, files, HTTP, archives of tiles in tables."""
