"""Part of the urban analytics library."""
