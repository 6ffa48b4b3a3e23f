"""Geometries as GeoJSON text or arrays of positions (structs of lon, lat): points that stand for them, distances, checks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M_PER_DEG = 111_320.0
POSITIONS = "array<struct<lon:double,lat:double>>"
#: Vertices compared of a geometry, evenly taken from so many of its first.
SAMPLED, FIRST_VERTICES = 24, 512


def kind_of(geojson: Column) -> Column:
    return F.get_json_object(geojson, "$.type")


def positions(geojson: Column) -> Column:
    """All positions of a GeoJSON geometry in order, whatever its depth; empty without any. Of a collection, those of all its members."""
    pairs = F.regexp_extract_all(geojson, F.lit(r"\[\s*(-?[0-9][0-9.eE+-]*\s*,\s*-?[0-9][0-9.eE+-]*)"), F.lit(1))
    return F.transform(F.coalesce(pairs, F.array().cast("array<string>")), lambda p: F.struct(F.trim(F.split(p, ",")[0]).try_cast("double").alias("lon"), F.trim(F.split(p, ",")[1]).try_cast("double").alias("lat")))


def rings(geojson: Column) -> Column:
    """The outer ring of every polygon, its closing position left out; of other geometries all positions, as one."""
    kind = kind_of(geojson)
    # A polygon's first ring is what lies before the first close of a ring; polygons of several are parted first.
    polygons = F.when(kind == "MultiPolygon", F.split(geojson, r"\]\s*\]\s*\]\s*,")).otherwise(F.array(geojson))
    outer = F.transform(polygons, lambda p: F.split(p, r"\]\s*\]", 2)[0])
    cut = F.transform(outer, lambda p: F.slice(positions(p), 1, F.greatest(F.size(positions(p)) - 1, F.lit(0))))
    return F.when(kind.isin("Polygon", "MultiPolygon"), cut).otherwise(F.array(positions(geojson)))


def mean_of(points: Column) -> Column:
    """Mean position; (0, 0) without any."""
    n = F.size(points)
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k])
    return F.struct(F.when(n > 0, total("lon") / n).otherwise(0.0).alias("lon"), F.when(n > 0, total("lat") / n).otherwise(0.0).alias("lat"))


def representative_point(geojson: Column) -> Column:
    """Mean of the vertices; of polygons of the outer rings' without the closing one."""
    return mean_of(F.flatten(rings(geojson)))


def centroid(geojson: Column) -> Column:
    """Mean of all positions, closing ones too."""
    return mean_of(positions(geojson))


def middle_vertex(points: Column) -> Column:
    """The vertex in the middle (of an even number, the later), as flows are placed."""
    return F.try_element_at(points, (F.floor(F.size(points) / 2) + 1).cast("int"))


def midpoint(points: Column) -> Column:
    """The point half way along a line, in degrees."""
    legs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.size(points)), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.sqrt(F.pow(b.lon - a.lon, 2) + F.pow(b.lat - a.lat, 2)).alias("d")))
    half = F.aggregate(legs, F.lit(0.0), lambda s, leg: s + leg.d) / 2
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))

    def walk(s, leg):
        t = F.when(leg.d > 0, F.greatest(F.lit(0.0), (half - s.done) / leg.d)).otherwise(0.0)
        here = s.lon.isNull() & (s.done + leg.d >= half)
        return F.struct((s.done + leg.d).alias("done"), F.when(here, leg.a.lon + t * (leg.b.lon - leg.a.lon)).otherwise(s.lon).alias("lon"), F.when(here, leg.a.lat + t * (leg.b.lat - leg.a.lat)).otherwise(s.lat).alias("lat"))

    found = F.aggregate(legs, start, walk)
    return F.when(F.size(points) < 2, points[0]).otherwise(F.struct(found.lon.alias("lon"), found.lat.alias("lat")))


def sampled(points: Column) -> Column:
    """At most SAMPLED vertices, evenly from the first FIRST_VERTICES."""
    some = F.slice(points, 1, FIRST_VERTICES)
    n = F.size(some)
    even = F.transform(F.sequence(F.lit(0), F.lit(SAMPLED - 1)), lambda i: some[F.floor(i * n / F.lit(float(SAMPLED))).cast("int")])
    return F.when(n <= SAMPLED, some).otherwise(even)


def polyline_distance_m(a: Column, b: Column) -> Column:
    """Least distance of the vertices of either line from the other, in local metres about their first latitudes; infinite if one is empty."""
    cos = F.cos(F.radians((a[0].lat + b[0].lat) / 2))

    def legs(line: Column) -> Column:
        own = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.size(line)), lambda x, y: F.struct(x.alias("p"), y.alias("q")))
        return F.when(F.size(line) == 1, F.array(F.struct(line[0].alias("p"), line[0].alias("q")))).otherwise(own)

    def one_way(points: Column, line: Column) -> Column:
        def from_leg(p, leg):
            ax, ay = (leg.p.lon - p.lon) * M_PER_DEG * cos, (leg.p.lat - p.lat) * M_PER_DEG
            dx, dy = (leg.q.lon - leg.p.lon) * M_PER_DEG * cos, (leg.q.lat - leg.p.lat) * M_PER_DEG
            size = dx * dx + dy * dy
            t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size))).otherwise(0.0)
            return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

        return F.array_min(F.transform(points, lambda p: F.array_min(F.transform(legs(line), lambda leg: from_leg(p, leg)))))

    return F.when((F.size(a) < 1) | (F.size(b) < 1), F.lit(float("inf"))).otherwise(F.least(one_way(a, b), one_way(b, a)))


def plausible_wgs84(lon: Column, lat: Column) -> Column:
    return F.coalesce((F.abs(lon) <= 180) & (F.abs(lat) <= 90) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def envelope(points: Column) -> Column:
    side = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return F.struct(side(F.array_min, "lon").alias("west"), side(F.array_min, "lat").alias("south"), side(F.array_max, "lon").alias("east"), side(F.array_max, "lat").alias("north"))


def implausible(geojson: Column) -> Column:
    """Reasons against a geometry: malformed, empty, out of range (a number beyond doubles isn't finite)."""
    pts, kind = positions(geojson), kind_of(geojson)
    nested = F.get_json_object(geojson, "$.coordinates")
    first_ring = F.regexp_extract(nested, r"\[\s*(\[\s*\[[^\[\]]*\](?:\s*,\s*\[[^\[\]]*\])*\s*\])", 1)
    ring = positions(first_ring)
    closed = (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    shaped = (
        F.when(kind == "Point", nested.rlike(r"^\s*\[\s*-?[0-9]") & (F.size(pts) == 1)).when(kind == "MultiPoint", nested.rlike(r"^\s*\[\s*\[\s*-?[0-9]"))
        .when(kind == "LineString", nested.rlike(r"^\s*\[\s*\[\s*-?[0-9]") & (F.size(pts) >= 2)).when(kind == "MultiLineString", nested.rlike(r"^\s*\[\s*\[\s*\[\s*-?[0-9]") & (F.size(pts) >= 2))
        .when(kind == "Polygon", nested.rlike(r"^\s*\[\s*\[\s*\[\s*-?[0-9]") & closed).when(kind == "MultiPolygon", nested.rlike(r"^\s*\[\s*\[\s*\[\s*\[\s*-?[0-9]"))
        .when(kind == "GeometryCollection", F.get_json_object(geojson, "$.geometries").isNotNull())
    )
    wild = F.exists(pts, lambda p: ~F.coalesce((F.abs(p.lon) <= 180) & (F.abs(p.lat) <= 90), F.lit(False)))
    endless = F.exists(pts, lambda p: F.abs(p.lon).isin(float("inf")) | F.abs(p.lat).isin(float("inf")))
    return F.array_compact(F.array(F.when(~F.coalesce(shaped, F.lit(False)), "geometry_malformed"), F.when(F.size(pts) == 0, "geometry_empty"), F.when(endless, "geometry_not_finite"), F.when(wild, "geometry_out_of_range")))


def densified(points: Column, spacing_m: float = 45.0, most: int = 200) -> Column:
    """Points along a line at most ``spacing_m`` apart; of more than ``most`` every so many, evenly, and the last."""
    legs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.size(points)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def along(leg):
        lat1, lat2 = F.radians(leg.a.lat), F.radians(leg.b.lat)
        h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(F.radians(leg.b.lon - leg.a.lon) / 2), 2)
        steps = F.greatest(F.lit(1), F.ceil(2 * 6_371_000.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h))) / spacing_m)).cast("int")
        return F.transform(F.sequence(F.lit(1), steps), lambda s: F.struct((leg.a.lon + (leg.b.lon - leg.a.lon) * (s / steps)).alias("lon"), (leg.a.lat + (leg.b.lat - leg.a.lat) * (s / steps)).alias("lat")))

    out = F.concat(F.slice(points, 1, 1), F.flatten(F.transform(legs, along)))
    n = F.size(out)
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(i == most - 1, F.element_at(out, -1)).otherwise(out[F.floor(i * n / F.lit(float(most))).cast("int")]))
    return F.when(F.size(points) <= 1, points).when(n <= most, out).otherwise(even)


def decoded_polyline(c: Column) -> Column:
    """Positions of an encoded polyline (groups of five bits, zigzag differences of 1e-5 degrees, lat before lon)."""
    chunks = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x) - 63)
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("v"), F.lit(0).alias("s"))

    def step(a, x):
        v = a.v.bitwiseOR(F.call_function("shiftleft", x.bitwiseAND(31), a.s))
        z = F.when(v.bitwiseAND(1) == 1, -(F.shiftright(v, 1)) - 1).otherwise(F.shiftright(v, 1))
        more = x >= 32
        return F.struct(F.when(more, a.out).otherwise(F.concat(a.out, F.array(z))).alias("out"), F.when(more, v).otherwise(0).alias("v"), F.when(more, a.s + 5).otherwise(0).alias("s"))

    diffs = F.aggregate(chunks, start, step, lambda a: a.out)
    total = lambda i, k: F.aggregate(F.filter(F.slice(diffs, 1, i * 2 + 2), lambda x, j: j % 2 == k), F.lit(0), lambda s, x: s + x) / 100_000.0
    return F.when(F.size(diffs) < 2, F.array().cast(POSITIONS)).otherwise(F.transform(F.sequence(F.lit(0), (F.size(diffs) / 2).cast("int") - 1), lambda i: F.struct(total(i, 1).alias("lon"), total(i, 0).alias("lat"))))


def wkt_positions(c: Column) -> Column:
    """Positions of a WKT point or line."""
    pairs = F.regexp_extract_all(c, F.lit(r"(-?[0-9][0-9.eE+-]*\s+-?[0-9][0-9.eE+-]*)"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("lon"), F.split(p, r"\s+")[1].cast("double").alias("lat")))


def geojson_of(points: Column) -> Column:
    """GeoJSON text: a point for one position, else a line."""
    pair = lambda p: F.array(p.lon, p.lat)
    return F.when(F.size(points) == 1, F.to_json(F.struct(F.lit("Point").alias("type"), pair(points[0]).alias("coordinates")))).when(F.size(points) > 1, F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, pair).alias("coordinates"))))


def tile_envelope(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """West, south, east and north of a web map tile."""
    n = 2**z
    if not (0 <= x < n and 0 <= y < n):
        raise ValueError("no such tile")
    lat = lambda k: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * k / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def tile_position(lon: Column, lat: Column, z: int, x: int, y: int, extent: int = 4096) -> Column:
    """Place within a tile in its own units, from its upper left corner."""
    n = 2**z
    across = (lon + 180) / 360 * n - x
    down = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n - y
    return F.struct(F.round(across * extent).cast("int").alias("x"), F.round(down * extent).cast("int").alias("y"))
