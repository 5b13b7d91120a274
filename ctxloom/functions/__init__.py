"""ctxloom functions."""
