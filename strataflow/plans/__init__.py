"""Declared runs."""
