"""Operators for preparing training text, each a Spark job over a table of documents or pages."""
