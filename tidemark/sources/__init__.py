"""Readers for tables, change feeds, API documents and enclosures."""
