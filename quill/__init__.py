"""Quill: multilingual document retrieval and corpus processing as Spark plans."""
