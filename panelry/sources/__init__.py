"""Readers, writers, table contracts and the retail views."""
