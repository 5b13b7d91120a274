"""ctxloom operators."""
