"""DataFrame operators: pyramids, windows, graphs, paths, metrics, coverage, tiles."""
