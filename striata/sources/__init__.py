"""sources of the columnar toolkit."""
