"""Streams: resumable ingest and windowed counts."""
