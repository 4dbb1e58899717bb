"""Readers, ingest normalisation, sinks and test bindings."""
