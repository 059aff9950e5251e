"""Relational operators over the tables of graphlens.schema."""
