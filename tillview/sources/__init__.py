"""Readers, declared schemas and intermediate storage."""
