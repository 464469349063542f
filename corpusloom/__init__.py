"""Corpus, retrieval and question-answering data engine on PySpark DataFrames."""

__version__ = "0.1.0"
