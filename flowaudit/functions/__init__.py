"""Column-level building blocks shared by all operators."""
