"""Operators: the calls, their state, and the verb."""
