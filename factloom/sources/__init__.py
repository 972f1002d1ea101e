"""Readers, writers and the relational facade over stored tables."""
