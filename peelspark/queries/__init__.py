"""Registered queries: every operator over whole driver tables, with SQL where SQL can express it."""
