"""Ready-made queries over the benchmark tables, and the four audit studies."""
