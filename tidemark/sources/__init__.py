"""Readers and sinks: feeds, ledgers, upserts."""
