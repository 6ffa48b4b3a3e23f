"""OpenLR line references in their published binary form (version 3): decoding, encoding, and resolving many at once.

A reference is a chain of points, each with the road's class, form and bearing
and the distance to the next; matching it to a road network is the caller's
``match`` over distinct references.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres of one step of distances, degrees of one sector of bearings, parts of an offset.
STEP_M, SECTOR_DEG, OFFSET_PARTS = 58.6, 11.25, 256
SCHEMA = "points array<struct<lon:double,lat:double,frc:int,fow:int,bearing:double,lowest_frc:int,metres:double>>, from_start double, from_end double"


@dataclass
class Point:
    lon: float
    lat: float
    frc: int
    fow: int
    bearing: float
    lowest_frc: int | None = None
    metres: float | None = None


def absolute(b: bytes) -> float:
    n = int.from_bytes(b, "big", signed=True)
    return (n - (0.5 if n > 0 else -0.5 if n < 0 else 0)) * 360 / 2**24


def decode(data: bytes) -> tuple[list[Point], float, float]:
    """(points, offset from the start, offset from the end), the offsets as shares of the first and last leg; ValueError for other locations."""
    if len(data) < 16 or data[0] & 0x07 != 3 or data[0] & 0x68 != 0x08:
        raise ValueError("not a line reference of version 3")
    points, at = [], 7
    lon, lat = absolute(data[1:4]), absolute(data[4:7])
    last = False
    while True:
        a, b = data[at], data[at + 1]
        p = Point(lon, lat, a >> 3 & 7, a & 7, (b & 31) * SECTOR_DEG + SECTOR_DEG / 2)
        points.append(p)
        if last:
            break
        p.lowest_frc, p.metres = b >> 5, (data[at + 2] + 0.5) * STEP_M
        at += 3
        dx, dy = struct.unpack(">hh", data[at : at + 4])
        lon, lat, at = lon + dx / 1e5, lat + dy / 1e5, at + 4
        last = len(data) - at < 9  # what is left is the last point, with or without offsets
    flags, rest = b, data[at + 2 :]
    start, end = bool(flags & 0x40), bool(flags & 0x20)
    if len(rest) != start + end:
        raise ValueError("a reference of another length than its flags say")
    share = lambda x: (x + 0.5) / OFFSET_PARTS
    return points, share(rest[0]) if start else 0.0, share(rest[-1]) if end else 0.0


def encode(points: list[Point], from_start: float = 0.0, from_end: float = 0.0) -> bytes:
    """The binary form of a line of two points or more; positions after the first are rounded to 1e-5 degrees from the one before."""
    fixed = lambda d: round((0.5 if d > 0 else -0.5 if d < 0 else 0) + d * 2**24 / 360).to_bytes(3, "big", signed=True)
    out = bytearray([0x0B]) + fixed(points[0].lon) + fixed(points[0].lat)
    lon, lat = absolute(bytes(out[1:4])), absolute(bytes(out[4:7]))
    for i, p in enumerate(points):
        if i:
            dx, dy = round((p.lon - lon) * 1e5), round((p.lat - lat) * 1e5)
            out += struct.pack(">hh", dx, dy)
            lon, lat = lon + dx / 1e5, lat + dy / 1e5
        sector = int(p.bearing % 360 / SECTOR_DEG)
        out.append(p.frc << 3 | p.fow)
        if i < len(points) - 1:
            out += bytes([(p.lowest_frc or 0) << 5 | sector, min(255, int((p.metres or 0) / STEP_M))])
        else:
            out.append((0x40 if from_start else 0) | (0x20 if from_end else 0) | sector)
    return bytes(out + bytes(int(s * OFFSET_PARTS) for s in (from_start, from_end) if s))


def decoded(reference: Column) -> Column:
    """The decoded form of base64 references, null for those that can't be read."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                points, a, b = decode(base64.b64decode(t or "", validate=True))
                out.append(([p.__dict__ for p in points], a, b))
            except (ValueError, IndexError, struct.error):
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["points", "from_start", "from_end"])

    return run(reference)


def resolved(rows: DataFrame, match: Callable[[DataFrame], DataFrame], column: str = "openlr") -> DataFrame:
    """Rows with the geometry (points) their reference resolves to; those without are dropped.

    Every distinct reference is matched once: match takes (openlr, decoded) and returns (openlr, points).
    """
    refs = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("openlr")).distinct()
    found = match(refs.withColumn("decoded", decoded(F.col("openlr"))).where("decoded.points is not null"))
    return rows.join(found.where("size(points) > 0"), rows[column] == found["openlr"]).drop(found["openlr"])


def straight(refs: DataFrame) -> DataFrame:
    """The simplest match: the line through the reference's points."""
    return refs.select("openlr", F.transform("decoded.points", lambda p: F.struct(p.lon.alias("lon"), p.lat.alias("lat"))).alias("points"))
