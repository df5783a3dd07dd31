"""Cairn operators."""
