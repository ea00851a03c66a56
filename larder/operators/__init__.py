"""Relational and analytical operators."""
