"""Retrieval analytics on Spark: documents, chunks, vectors, search, selection, evaluation."""
