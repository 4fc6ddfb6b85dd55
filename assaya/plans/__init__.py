"""Registered queries: operators bound to tables, with their SQL."""
