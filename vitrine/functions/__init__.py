"""Column-valued scalar functions; all null-in, null-out unless stated."""
