"""Queries: thin bindings of operators to tables, with the SQL they are checked against."""
