"""Box and coordinate expressions. Boxes are (x, y, w, h) columns or arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


def intersection(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    wide = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    high = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Overlap over union; null unless both boxes have a positive size."""
    both = intersection(*a, *b)
    ok = (a[2] > 0) & (a[3] > 0) & (b[2] > 0) & (b[3] > 0)
    return F.when(ok, both / (a[2] * a[3] + b[2] * b[3] - both))


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")  # type: ignore[return-value]


def box_iou(a: Column, b: Column) -> Column:
    """The same for array columns."""
    return iou(tuple(a[i] for i in range(4)), tuple(b[i] for i in range(4)))  # type: ignore[arg-type]


def center_to_corner(b: Column) -> Column:
    """[xc, yc, w, h] to [x, y, w, h]."""
    return F.array(b[0] - b[2] / 2.0, b[1] - b[3] / 2.0, b[2], b[3])


def corner_to_center(b: Column) -> Column:
    return F.array(b[0] + b[2] / 2.0, b[1] + b[3] / 2.0, b[2], b[3])


def size_to_corners(b: Column) -> Column:
    """[x, y, w, h] to [x0, y0, x1, y1]."""
    return F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])


def corners_to_size(b: Column) -> Column:
    return F.array(b[0], b[1], b[2] - b[0], b[3] - b[1])


def rescale(b: Column, fx: Column, fy: Column) -> Column:
    return F.array(b[0] * fx, b[1] * fy, b[2] * fx, b[3] * fy)


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    return rescale(b, width.cast("double"), height.cast("double"))


def to_relative(b: Column, width: Column, height: Column) -> Column:
    return rescale(b, 1.0 / width, 1.0 / height)


def clip_relative(corners_px: Column, width: Column, height: Column) -> Column:
    """Pixel corners to a relative box inside [0, 1]."""
    x = F.least(F.greatest(corners_px[0] / width, F.lit(0.0)), F.lit(1.0))
    y = F.least(F.greatest(corners_px[1] / height, F.lit(0.0)), F.lit(1.0))
    w = F.least(F.greatest((corners_px[2] - corners_px[0]) / width, F.lit(0.0)), 1.0 - x)
    h = F.least(F.greatest((corners_px[3] - corners_px[1]) / height, F.lit(0.0)), 1.0 - y)
    return F.array(x, y, w, h)


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def gap(a: Column, b: Column, corners: bool = True) -> Column:
    """Distance between two rectangles, 0 if they touch. corners: [x0, y0, x1, y1], else [x, y, w, h]."""
    if not corners:
        a, b = size_to_corners(a), size_to_corners(b)
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def tile_starts(size: int, tile: int, stride: int) -> list[int]:
    """Starts of tiles along one axis; the last tile ends at the border."""
    if size <= tile:
        return [0]
    starts = list(range(0, size - tile + 1, stride))
    return starts if starts[-1] == size - tile else [*starts, size - tile]


def tiles(width: Column, height: Column, tile_w: int, tile_h: int, stride_w: int | None = None, stride_h: int | None = None) -> Column:
    """Array of (x, y) of the tiles of an image, row by row; by default they overlap by half."""

    def axis(size: Column, tile: int, stride: int) -> Column:
        inner = F.sequence(F.lit(0), size - tile, F.lit(stride))
        return F.when(size <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(inner, F.array(size - tile))))

    xs, ys = axis(width, tile_w, stride_w or tile_w // 2), axis(height, tile_h, stride_h or tile_h // 2)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds and hemisphere to signed degrees."""
    v = d + m / 60.0 + s / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -v).when(F.upper(ref).isin("N", "E"), v)


def gps_status(has_exif: Column, has_gps: Column, lat: Column, lon: Column) -> Column:
    """no_exif_info, no_gps_info, null_island or success."""
    bad = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon) | ~lat.between(-90, 90) | ~lon.between(-180, 180)
    return F.when(~has_exif, "no_exif_info").when(~has_gps | bad, "no_gps_info").when((lat == 0) & (lon == 0), "null_island").otherwise("success")
