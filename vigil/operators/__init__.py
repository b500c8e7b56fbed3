"""Operators over signals, intervals, windows, embeddings and prompts."""
