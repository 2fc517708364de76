"""Fixtures: the library's logical tables, derived from the star-schema test tables."""
