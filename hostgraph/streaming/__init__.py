"""Structured Streaming variants of the edge table and per-flow novelty."""
