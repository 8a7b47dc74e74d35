"""generators of the library."""
