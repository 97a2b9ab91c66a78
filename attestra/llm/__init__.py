"""Operators of a training-data pipeline: each works on a table of texts, pages or conversations."""
