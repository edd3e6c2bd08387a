"""Operators for large text corpora. Nothing outside this folder imports it, except the guarded import in __spark_entry__.py."""
