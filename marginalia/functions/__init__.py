"""Marginalia: functions."""
