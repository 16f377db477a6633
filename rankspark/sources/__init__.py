"""Readers, writers and mapped views."""
