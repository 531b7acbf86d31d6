"""Column functions: normalisers, parsers, masks and distribution functions."""
