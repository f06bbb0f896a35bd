"""Marginalia: streaming."""
