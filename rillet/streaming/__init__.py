"""The incremental layer on Structured Streaming. Late audited rows replace live ones, so sinks are upserts by key and not appends."""

from .tables import daily_totals, deduplicated, stuck_flags, upsert_stream  # noqa: F401
