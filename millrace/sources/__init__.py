"""Readers, writers and deterministic generators."""
