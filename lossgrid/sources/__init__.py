"""Schemas, readers, sinks and the test-table mapping."""
