"""Column-level helpers: naming, keys, casts, roles and safe ratios."""
