"""Relational and sequence operators over the archive tables."""
