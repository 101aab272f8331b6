"""Registered queries: operators applied to the given tables, with SQL that gives the same rows where there is any."""
