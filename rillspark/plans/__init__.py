"""Registered queries: each applies an operator to the given tables, next to the SQL it is compared with."""
