"""operators of the columnar toolkit."""
