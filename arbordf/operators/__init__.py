"""Relational operators beyond Spark's own: hierarchies, node joins, currency conversion."""
