"""Structured Streaming forms of the ledger and index operators."""
