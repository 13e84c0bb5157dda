"""Registered queries with their reference SQL, grouped by area."""
