"""Planning of calls."""
