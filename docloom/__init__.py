"""Curation of document question-answering corpora, and of training text, on Spark."""
