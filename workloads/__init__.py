"""Registered queries over the shared test tables, and their SQL twins."""
