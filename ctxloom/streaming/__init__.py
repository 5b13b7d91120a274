"""ctxloom streaming."""
