"""Scalar functions: of hierarchy nodes, and those that Spark lacks or defines otherwise."""
