"""Query text to logical plans."""
