"""Reading and writing of cell tables, rasters and polygons."""
