"""Eventloom: search, statistics and streaming ingest for typed, sparse events on Spark."""
