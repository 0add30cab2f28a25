"""Relational operators; every one works on all places at once."""
