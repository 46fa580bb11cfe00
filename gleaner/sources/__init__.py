"""Scans and sinks: file trees, registries, page snapshots and the chunk index."""
