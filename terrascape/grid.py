"""Grid metadata and the checks of parameters that don't need data."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Unit names and their kilometres.
UNIT_KM = {
    "metre": 0.001, "meter": 0.001, "metres": 0.001, "meters": 0.001, "m": 0.001,
    "kilometre": 1.0, "kilometer": 1.0, "kilometres": 1.0, "kilometers": 1.0, "km": 1.0,
    "foot": 0.0003048, "feet": 0.0003048, "ft": 0.0003048, "us survey foot": 0.0003048, "us survey feet": 0.0003048,
}
KM_A_DEGREE = 111.32


@dataclass(frozen=True)
class Grid:
    """Rows, columns and the affine transform (a, b, c, d, e, f): x = a*col + b*row + c, y = d*col + e*row + f.

    is_geo None: guessed from the resolution and bounds. unit: of projected coordinates.
    """

    nrows: int
    ncols: int
    transform: tuple[float, float, float, float, float, float] = (1000.0, 0.0, 0.0, 0.0, -1000.0, 0.0)
    is_geo: bool | None = False
    unit: str = "metre"
    nodata: float | None = None
    bands: int = 1
    crs: str | None = field(default=None)

    def __post_init__(self):
        if self.nrows < 0 or self.ncols < 0:
            raise ValueError("a grid can't have fewer than 0 rows or columns")
        if len(self.transform) != 6:
            raise ValueError("a transform has six numbers")
        if self.is_geo is None:
            object.__setattr__(self, "is_geo", self._guess())

    def _guess(self) -> bool:
        x, y = self.resolution
        if x < 1 and y < 1:
            return True
        if x > 1 and y > 1:
            return False
        left, bottom, right, top = self.bounds
        return left >= -180 and right <= 180 and bottom >= -90 and top <= 90

    @property
    def resolution(self) -> tuple[float, float]:
        return abs(self.transform[0]), abs(self.transform[4])

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.box(0, self.nrows, 0, self.ncols)

    def box(self, row_start: int, row_stop: int, col_start: int, col_stop: int) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax of a range of rows and columns."""
        a, b, c, d, e, f = self.transform
        corners = [(a * q + b * r + c, d * q + e * r + f) for r in (row_start, row_stop) for q in (col_start, col_stop)]
        xs, ys = zip(*corners, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def level_transform(self, level: int) -> tuple[float, ...]:
        """Transform of the cells of a level, in global indices."""
        a, b, c, d, e, f = self.transform
        return a * level, b * level, c, d * level, e * level, f

    def km(self) -> tuple[float, float] | None:
        """Resolution in km: at the centre latitude for degrees; None for an unknown unit."""
        x, y = self.resolution
        if self.is_geo:
            _, bottom, _, top = self.bounds
            return x * KM_A_DEGREE * abs(math.cos(math.radians((bottom + top) / 2))), y * KM_A_DEGREE
        factor = UNIT_KM.get(self.unit.lower())
        return None if factor is None else (x * factor, y * factor)

    def require_same_shape(self, other: Grid, what: str) -> None:
        if (self.nrows, self.ncols) != (other.nrows, other.ncols):
            raise ValueError(f"{what} has {other.nrows} x {other.ncols} cells, the condition {self.nrows} x {self.ncols}")
        if self.crs and other.crs and self.crs != other.crs:
            raise ValueError(f"{what} is in {other.crs}, the condition in {self.crs}; reproject it first")


def nearest_power_of_two(n: int) -> int:
    """Ties go to the lower power."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"a level is a positive integer, not {n!r}")
    lower = 1 << (n.bit_length() - 1)
    return lower if n - lower <= 2 * lower - n else 2 * lower


def pyramid_levels(levels: Iterable[int]) -> list[int]:
    """Levels as powers of two with 1 among them; each must be twice the one before."""
    if levels is None:
        raise ValueError("levels are needed")
    out = sorted({1, *map(nearest_power_of_two, levels)})
    if any(b != 2 * a for a, b in zip(out[:-1], out[1:], strict=True)):
        raise ValueError(f"levels must double without a gap: {out}")
    return out


def window_mode(mode: str) -> str:
    out = str(mode).strip().lower()
    if out not in ("circular", "square"):
        raise ValueError(f"window_mode is 'circular' or 'square', not {mode!r}")
    return out


@dataclass(frozen=True)
class Params:
    """Parameters that the indicators share, with their defaults; checked when made."""

    lambdas: tuple[float, ...] = (2.0, 20.0, 200.0)
    max_cost: float = 2.0
    window_size: int = 3
    outer_window: int = 9
    window_mode: str = "circular"
    levels: tuple[int, ...] = (2, 4, 8, 16, 32)
    option: int = 3
    #: Accepted and checked; results don't depend on it, as they are cropped. None: 32, or what is read if that is less.
    margin_px: int | None = None

    def __post_init__(self):
        for name in ("window_size", "outer_window"):
            v = getattr(self, name)
            if not isinstance(v, int) or v < 1 or v % 2 == 0:
                raise ValueError(f"{name} is an odd positive integer, not {v!r}")
        object.__setattr__(self, "outer_window", max(self.outer_window, self.window_size))
        object.__setattr__(self, "window_mode", window_mode(self.window_mode))
        object.__setattr__(self, "levels", tuple(pyramid_levels(self.levels)))
        object.__setattr__(self, "lambdas", tuple(map(float, self.lambdas)))
        if self.option not in (1, 2, 3):
            raise ValueError(f"option is 1, 2 or 3, not {self.option!r}")
        most = (self.outer_window + 3) * self.levels[-1]
        if self.margin_px is None:
            object.__setattr__(self, "margin_px", min(32, most))
        if not 0 <= self.margin_px <= most:
            raise ValueError("margin_px reaches beyond what is read")

    def radii(self, level: int) -> tuple[float, float]:
        """Inner and outer radius of a level's ring, in pixels."""
        outer = level * (self.outer_window if level == self.levels[-1] else self.window_size)
        return (0.0 if level == 1 else level * self.window_size / 2), float(outer)

    @property
    def reach(self) -> int:
        """Pixels from a source to the farthest that its window can hold."""
        return max(int(self.radii(level)[1]) + level for level in self.levels)


def compact(value: float) -> str:
    """Short text of a number: thousands as K, M, B, else four digits."""
    for size, letter in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if value >= size:
            return f"{value / size:.2f}{letter}"
    return str(int(value)) if float(value).is_integer() else f"{value:.4g}"
