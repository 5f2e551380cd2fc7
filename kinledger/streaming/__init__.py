"""Structured Streaming over the ledger's journal."""
