"""Chunking of text, documents and source code, as Spark DataFrames."""
