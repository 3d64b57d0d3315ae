"""Readers, writers and nested-table discovery."""
