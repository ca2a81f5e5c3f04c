"""Structured Streaming ingest: file source -> foreachBatch -> keyed tables."""

from shredkit.streaming.ingest import ingest_stream, ingest_text_stream, stream_key

__all__ = ["ingest_stream", "ingest_text_stream", "stream_key"]
