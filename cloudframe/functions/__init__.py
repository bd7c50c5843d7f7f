"""Column functions: vectors, rotations, angles."""
