"""Operators over event DataFrames: queries, analytics, alert rules, the event store."""
