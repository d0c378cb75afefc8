"""Structured Streaming ingest."""
from seqweave.streaming.pairs import stream_pairs  # noqa: F401
