"""Rewrite programs: what a conversion does, compiled before any row is read."""
