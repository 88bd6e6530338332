"""Registered queries, each beside the SQL it is checked against."""
