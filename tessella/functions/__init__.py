"""Column functions and their vectorised twins."""
