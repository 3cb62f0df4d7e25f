"""Queries, the whole plan and their SQL."""
