"""Operators for training-data pipelines over text, code and vectors."""
