"""The ingest jobs as streams; each gives what its batch form gives."""
