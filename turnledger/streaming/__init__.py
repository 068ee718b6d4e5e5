"""Ingest as a stream over a landing folder."""
