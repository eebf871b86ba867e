"""Gold plans: their description, execution, and derivation from wanted column names."""
