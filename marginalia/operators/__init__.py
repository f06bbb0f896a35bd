"""Marginalia: operators."""
