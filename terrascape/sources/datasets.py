"""Names of example rasters, and where a user keeps them."""

from __future__ import annotations

#: The names of the example layers.
NAMES = (
    "site_condition", "pa_proportion", "transgrids/1990", "transgrids/ACC50_85", "transgrids/GFD50_85",
    "transgrids/IPS50_26", "transgrids/IPS50_45", "transgrids/IPS50_60", "transgrids/IPS50_85",
)


def example_data_path(name: str, root: str = "examples/data") -> str:
    """Path of an example layer below root; the layers themselves aren't part of this package."""
    if name not in NAMES:
        raise ValueError(f"no example layer {name!r}; there are {', '.join(NAMES)}")
    return f"{root.rstrip('/')}/{name}.tif"
