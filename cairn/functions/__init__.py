"""Cairn functions."""
