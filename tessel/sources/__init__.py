"""Readers, writers and change detection."""
