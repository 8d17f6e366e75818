"""The ingest as a stream of landed payloads."""
