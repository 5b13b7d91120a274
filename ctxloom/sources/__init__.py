"""ctxloom sources."""
