"""Readers, writers and input fixtures."""
