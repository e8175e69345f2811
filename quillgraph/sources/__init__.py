"""Reading stage files and writing the graph store."""
