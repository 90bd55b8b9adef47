"""Readers: project tables, JSON documents, file listings, raw stage output."""
