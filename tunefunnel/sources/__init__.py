"""Schemas, table views, slice documents and sinks."""
