"""Column expressions (cleaning, text)."""
