

from terrascape.plans.files import beri, connectedness, make_tile, make_tiles, overview_info, pixel_coverage, resolution_info
from terrascape.sources.datasets import example_data_path
from terrascape.sources.rasters import read_raster

__all__ = ["beri", "connectedness", "example_data_path", "make_tile", "make_tiles", "overview_info", "pixel_coverage", "read_raster", "resolution_info"]
