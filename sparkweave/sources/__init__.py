"""Readers of corpora and graphs, keyed tables, and export layouts."""
