"""Providers of tables, views and partition functions; the relation registry; schema inference."""
