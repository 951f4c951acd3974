"""Subscriptions on Structured Streaming."""
