"""Operators for text and training-data pipelines. Nothing outside imports this."""
