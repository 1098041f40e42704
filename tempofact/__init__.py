"""Bi-temporal memory analytics on Spark: versioned facts, ranked recall, graphs, ingest and evaluation."""
