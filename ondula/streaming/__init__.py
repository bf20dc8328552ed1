"""Signals from streams."""
