"""Relational operators of the study."""
