"""Column-expression helpers: ratios, rounding, labels, ordering, text."""
