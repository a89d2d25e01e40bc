"""Physical-plan helpers: measured broadcasts and shared scratch space."""
