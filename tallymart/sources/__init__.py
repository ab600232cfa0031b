"""Parsers of messages and entity snapshots, fixture views, and the versioned mart folder."""
