"""Readers, ingestion checks and sinks."""
