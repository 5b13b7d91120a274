"""ctxloom plans."""
