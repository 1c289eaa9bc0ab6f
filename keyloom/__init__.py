"""Bilingual text quality analytics on PySpark."""
