"""Marginalia: sources."""
