"""Readers of landed material."""
