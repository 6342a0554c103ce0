"""Column-level helpers and the as-of machinery shared by the operators."""
