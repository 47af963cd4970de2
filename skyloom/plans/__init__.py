"""From a set of operators to one lazy table of cells."""
