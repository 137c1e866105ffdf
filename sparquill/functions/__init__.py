"""Scalar functions: text analysis, scoring, routing, snippets."""
