"""Column-level functions: scalars, predicates, row rules and metrics."""
