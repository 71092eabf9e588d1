"""functions of the columnar toolkit."""
