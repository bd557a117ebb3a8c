"""Fitted transformers under Structured Streaming."""
