"""Queries of the core and the SQL that states the same."""
