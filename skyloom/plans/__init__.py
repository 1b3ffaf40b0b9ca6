"""Registered queries, each with SQL that says the same."""
