"""Relational operators over code and document relations."""
