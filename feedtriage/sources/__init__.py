"""Landed payloads to entry tables."""
