"""Cairn streaming."""
