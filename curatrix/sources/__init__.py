"""Landed payloads as posts, tables in and out."""
