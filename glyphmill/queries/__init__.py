"""Registered queries over the corpus tables, each beside the SQL that gives the same rows."""
