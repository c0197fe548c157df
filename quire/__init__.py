"""Spark jobs for digitised document corpora."""
