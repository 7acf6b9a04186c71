"""Relational operators over tables of contents, pages and chapter queries."""
