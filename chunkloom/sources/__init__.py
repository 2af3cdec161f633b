"""Readers, writers and clients."""
