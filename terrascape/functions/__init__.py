"""Column builders: geometry of cells and windows, distances, kernels."""
