"""Statements: lexer, front-end, catalog statements, annotations, describe, system tables, SQL text."""
