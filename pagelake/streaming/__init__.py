"""Structured Streaming forms of the ledger and frontier jobs."""
