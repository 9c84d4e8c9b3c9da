"""Facts laid out by place: files sorted along a space-filling curve, and radius search that reads the cells around a point.

A row's key interleaves the bits of its latitude and longitude cells (Morton order), so that a square
of cells is one range of keys. A radius is covered by few such ranges; a scan with a predicate on the
key skips the files and row groups outside them by their statistics. The exact distance decides.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import METRES_PER_DEGREE, distance_m

#: Bits of a cell number on each side: cells of 180 / 2^20 degrees of latitude, about 20 metres.
BITS = 20
KEY = "geo_key"


def _cell(degrees: Column, width: float) -> Column:
    """The number of a cell, from degrees counted from the lower edge; the upper edge is in the last cell."""
    return F.least(F.greatest(F.floor(degrees.cast("double") / F.lit(width) * F.lit(2.0**BITS)), F.lit(0)), F.lit(2**BITS - 1)).cast("long")


def _spread(n: Column) -> Column:
    """A number's bits with a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def geo_key(lat: Column, lon: Column) -> Column:
    """The place of a point on the curve; null where either coordinate is missing."""
    return F.shiftleft(_spread(_cell(lat + 90, 180.0)), 1).bitwiseOR(_spread(_cell(lon + 180, 360.0)))


def write_by_place(facts: DataFrame, path: str, files: int, lat: str = "latitude", lon: str = "longitude", row_group_bytes: int | None = None) -> None:
    """Write facts sorted by place into about ``files`` files of even size; rows without a place come first. One shuffle by range."""
    writer = facts.withColumn(KEY, geo_key(F.col(lat), F.col(lon))).repartitionByRange(files, KEY).sortWithinPartitions(KEY).write
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(path)


def covering(south: float, north: float, west: float, east: float, most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` ranges of keys, in order, that hold all cells of a box: squares are split while that leaves cells out, the coarsest first."""
    side = 2**BITS
    at = lambda x, width: min(side - 1, max(0, math.floor(x / width * side)))
    y0, y1, x0, x1 = at(south + 90, 180.0), at(north + 90, 180.0), at(west + 180, 360.0), at(east + 180, 360.0)
    inside: list[tuple[int, int]] = []
    edge = [(0, 0, side, 0)]  # lower corner, side, first key
    while edge:
        split = []
        for y, x, s, key in edge:
            if y > y1 or x > x1 or y + s <= y0 or x + s <= x0:
                continue
            if s == 1 or (y0 <= y and x0 <= x and y + s - 1 <= y1 and x + s - 1 <= x1):
                inside.append((key, key + s * s - 1))
            else:
                h = s // 2
                split += [(y + dy * h, x + dx * h, h, key + (2 * dy + dx) * h * h) for dy in (0, 1) for dx in (0, 1)]
        kept = [(y, x, s, k) for y, x, s, k in split if not (y > y1 or x > x1 or y + s <= y0 or x + s <= x0)]
        if len(inside) + len(kept) > most:
            inside += [(k, k + s * s - 1) for _, _, s, k in kept]
            break
        edge = kept
    merged: list[tuple[int, int]] = []
    for a, b in sorted(inside):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def boxes_around(lat: float, lon: float, radius_m: float) -> list[tuple[float, float, float, float]]:
    """South, north, west and east of one or two boxes that hold a circle: two where it crosses the antimeridian, all longitudes where it holds a pole."""
    reach = radius_m / METRES_PER_DEGREE * 1.01  # degrees of a sphere are a little longer than the box's
    south, north = max(-90.0, lat - reach), min(90.0, lat + reach)
    if max(abs(lat - reach), abs(lat + reach)) >= 90:
        return [(south, north, -180.0, 180.0)]
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat)))))
    west, east = lon - wide, lon + wide
    if west < -180:
        return [(south, north, -180.0, east), (south, north, west + 360, 180.0)]
    if east > 180:
        return [(south, north, west, 180.0), (south, north, -180.0, east - 360)]
    return [(south, north, west, east)]


def key_ranges(lat: float, lon: float, radius_m: float, most: int = 64) -> list[tuple[int, int]]:
    """The ranges of keys that a radius search reads."""
    return [r for box in boxes_around(lat, lon, radius_m) for r in covering(*box, most)]


def within_radius(spark: SparkSession, path: str, lat: float, lon: float, radius_m: float, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Rows of facts written by ``write_by_place`` within a distance; the key's ranges reach the scan."""
    ranges = reduce(Column.__or__, [F.col(KEY).between(a, b) for a, b in key_ranges(lat, lon, radius_m)])
    near = distance_m(F.col(lat_col).cast("double"), F.col(lon_col).cast("double"), lat, lon) <= radius_m
    return spark.read.parquet(path).where(ranges).where(near).drop(KEY)
