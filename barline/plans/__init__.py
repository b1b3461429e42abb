"""Registered queries, grouped by area; each sits next to its oracle SQL."""
