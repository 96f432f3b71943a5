"""Readers, writers and versioned table storage."""
