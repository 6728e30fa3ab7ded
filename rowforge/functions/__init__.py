"""Functions over values and columns."""
