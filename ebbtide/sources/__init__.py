"""Readers, writers and schema mappings."""
