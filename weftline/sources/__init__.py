"""Readers, writers and strict loaders."""
