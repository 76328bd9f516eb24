"""Readers and writers of the supported formats."""
