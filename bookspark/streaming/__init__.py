"""Ingestion of books as their files arrive."""
