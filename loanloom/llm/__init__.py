"""Operators of a training-data pipeline: text, pages, conversations and embeddings."""
