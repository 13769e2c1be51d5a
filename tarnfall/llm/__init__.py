"""Operators on training text: name variants, similar vectors, near-duplicates, splitting, leaks, mixing, visual forms."""
