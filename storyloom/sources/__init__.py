"""Readers and writers of the outside formats."""
