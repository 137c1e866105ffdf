"""Readers of documents, queries and judgements."""
