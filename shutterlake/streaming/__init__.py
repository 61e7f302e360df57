"""Streams into the catalog's tables."""
