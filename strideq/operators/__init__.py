"""Operators on rows of events and on groups, each a DataFrame plan."""
