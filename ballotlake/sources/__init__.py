"""Readers and writers: test-table adapter, COPY text, snapshots, located facts, raw logs."""
