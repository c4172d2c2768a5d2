"""Part of the vocabulary engine."""
