"""Cairn: code-repository evidence analytics on PySpark DataFrames."""
