"""Readers of tables, pages and logs."""
