"""Operators of a training-data pipeline: texts, pages and vectors at scale."""
