"""Catalogs of form tables, file formats and databases."""
