"""Whole queries over the test tables, with the DuckDB SQL that each is held against."""
