"""Relational operators: state, gates, decisions, sessions, preferences."""
