"""Marginalia: plans."""
