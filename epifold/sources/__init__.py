"""Readers, writers, shared storage and literal dimension tables."""
