"""Readers of files and what becomes of them in Spark."""
