"""Road segments: building, matching sensors, observing, fusing, one-hop propagation."""

from __future__ import annotations

import base64
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.geometry import polyline_distance_m, tile_envelope, tile_position
from wayloom.functions.scalars import azimuth_deg, haversine_m, level_of_service, min_zoom
from wayloom.sources import openlr
from wayloom.sources.roads import form_of_way, road_class

# Declared levels of service, worst last, and tiers of sources, best first.
LOS_RANK = {"free_flow": 0, "heavy": 1, "queuing": 2, "stationary": 3, "blocked": 4}
TIERS = ["authoritative", "sensor", "peer", "crowd"]


def directed(ways: DataFrame) -> DataFrame:
    """One segment a direction: forward alone for oneway roads, else both; coords reversed for the backward one."""
    d = ways.select("*", F.explode(F.when(F.col("oneway"), F.array(F.lit("f"))).otherwise(F.array(F.lit("f"), F.lit("b")))).alias("dir"))
    coords = F.when(F.col("dir") == "b", F.reverse("coords")).otherwise(F.col("coords"))
    return d.select(F.concat_ws(":", "way_id", "dir").alias("segment_id"), "way_id", "dir", "highway", "ref", coords.alias("coords"), min_zoom(F.col("highway")).alias("min_zoom"), length_m("coords").alias("length_m"))


def length_m(coords: str):
    """Length of a polyline of (lon, lat) structs."""
    legs = f"transform(slice({coords}, 2, size({coords})), (b, i) -> struct({coords}[i] as a, b as b))"
    step = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(l.b.lat - l.a.lat) / 2), 2) + cos(radians(l.a.lat)) * cos(radians(l.b.lat)) * pow(sin(radians(l.b.lon - l.a.lon) / 2), 2))))"
    return F.expr(f"aggregate(transform({legs}, l -> {step}), 0D, (s, x) -> s + x)")


def legs_of(segments: DataFrame) -> DataFrame:
    """(sid, ref, leg, ax, ay, bx, by, ahead, total): the legs of every line (coords: structs of lon, lat) with the planar length before each and of all.

    Segments given as two points (ax, ay, bx, by) are one leg; without a ref they match any.
    """
    if "coords" in segments.columns:
        s = segments.select("sid", *(["ref"] if "ref" in segments.columns else [F.lit(None).cast("string").alias("ref")]), F.expr("transform(slice(coords, 2, size(coords)), (b, i) -> struct(i AS leg, coords[i].lon AS ax, coords[i].lat AS ay, b.lon AS bx, b.lat AS by))").alias("legs"))
    else:
        s = segments.select("sid", *(["ref"] if "ref" in segments.columns else [F.lit(None).cast("string").alias("ref")]), F.array(F.struct(F.lit(0).alias("leg"), "ax", "ay", "bx", "by")).alias("legs"))
    size = "sqrt(pow({0}.bx - {0}.ax, 2) + pow({0}.by - {0}.ay, 2))"
    s = s.withColumn("sizes", F.expr(f"transform(legs, l -> {size.format('l')})"))
    s = s.withColumn("total", F.expr("aggregate(sizes, 0D, (s, x) -> s + x)"))
    e = s.select("sid", "ref", "total", "sizes", F.inline("legs"))
    return e.withColumn("ahead", F.expr("aggregate(slice(sizes, 1, leg), 0D, (s, x) -> s + x)")).drop("sizes")


def match_sensors(sensors: DataFrame, segments: DataFrame, box: float = 0.003, nearest: int = 6, within_m: float = 35.0) -> DataFrame:
    """Best segment of each sensor: of the planar nearest six in the box those within 35 m whose ref the sensor's roads don't contradict, the closest.

    Sensors: (sensor_key, lon, lat), with ``roads`` (text) if known; a line's
    sensor point is its middle (geometry.midpoint). Legs go to every cell of
    ``box`` their envelope touches, grown by one, so one equi-join finds all that
    the box test keeps. fraction and bearing_deg are those of the whole line.
    """
    c = lambda x: F.floor(x / box)
    ex = F.sequence(c(F.least("ax", "bx")) - 1, c(F.greatest("ax", "bx")) + 1)
    ey = F.sequence(c(F.least("ay", "by")) - 1, c(F.greatest("ay", "by")) + 1)
    cells = legs_of(segments).withColumn("cx", F.explode(ex)).withColumn("cy", F.explode(ey))
    roads = F.col("roads") if "roads" in sensors.columns else F.lit(None).cast("string")
    pts = sensors.select("sensor_key", "lon", "lat", roads.alias("roads")).withColumns({"cx": c(F.col("lon")), "cy": c(F.col("lat"))})
    j = pts.join(cells, ["cx", "cy"]).where((F.least("ax", "bx") <= F.col("lon") + box) & (F.greatest("ax", "bx") >= F.col("lon") - box) & (F.least("ay", "by") <= F.col("lat") + box) & (F.greatest("ay", "by") >= F.col("lat") - box))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("lon") - F.col("ax")) * dx + (F.col("lat") - F.col("ay")) * dy) / size))).otherwise(0.0)
    j = j.withColumn("t", t).withColumns({"px": F.col("ax") + F.col("t") * dx, "py": F.col("ay") + F.col("t") * dy})
    planar = F.sqrt(F.pow(F.col("px") - F.col("lon"), 2) + F.pow(F.col("py") - F.col("lat"), 2))
    fraction = F.when(F.col("total") > 0, (F.col("ahead") + F.col("t") * F.sqrt(size)) / F.col("total")).otherwise(0.0)
    found = F.struct(planar.alias("planar"), "leg", fraction.alias("fraction"), haversine_m(F.col("lon"), F.col("lat"), F.col("px"), F.col("py")).alias("offset_m"), azimuth_deg(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("bearing_deg"))
    j = j.groupBy("sensor_key", "roads", "sid", "ref").agg(F.min(found).alias("x")).select("sensor_key", "roads", "sid", "ref", "x.*")
    near = Window.partitionBy("sensor_key").orderBy("planar", "sid")
    best = Window.partitionBy("sensor_key").orderBy("offset_m", "sid")
    guard = F.col("roads").isNull() | F.col("ref").isNull() | F.contains("roads", "ref")
    k = j.withColumn("r", F.row_number().over(near)).where(F.col("r") <= nearest).where((F.col("offset_m") <= within_m) & guard)
    return k.withColumn("b", F.row_number().over(best)).where("b = 1").select("sensor_key", "sid", "fraction", "offset_m", "bearing_deg")


def los_rank(c: str) -> Column:
    """Rank of a declared level; -1 for none."""
    return F.coalesce(*[F.when(F.col(c) == n, r) for n, r in LOS_RANK.items()], F.lit(-1))


def los_of_rank(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for n, r in LOS_RANK.items():
        out = F.when(rank == r, n).otherwise(out)
    return out


def segment_observations(flows: DataFrame, binding: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment and source: mean speed and free flow, rows, latest time, level of service, end of its life.

    flows: (sensor_key, source, observed_at, speed_kph, declared), and own_free_flow
    where the reading brings one; a row needs a speed or a declared level. The
    worst level declared by a row without a speed overrides the ratio's.
    """
    own = F.col("own_free_flow") if "own_free_flow" in flows.columns else F.lit(None).cast("double")
    usable = flows.where("speed_kph is not null or coalesce(declared, 'unknown') <> 'unknown'")
    j = usable.join(binding, "sensor_key").join(segments.select("segment_id", "free_flow_kph"), "segment_id").withColumn("ff", F.coalesce(own, "free_flow_kph"))
    rank = F.max(F.when(F.col("speed_kph").isNull(), los_rank("declared")).otherwise(-1))
    g = j.groupBy("segment_id", "source").agg(F.avg("speed_kph").alias("speed_kph"), F.count("*").alias("n"), F.max("observed_at").alias("observed_at"), F.avg("ff").alias("free_flow_kph"), rank.alias("rank"))
    ratio = F.when(F.col("free_flow_kph") > 0, F.col("speed_kph") / F.col("free_flow_kph"))
    out = g.withColumn("ratio", ratio).withColumn("los", F.coalesce(los_of_rank(F.col("rank")), level_of_service(F.col("ratio"))))
    return out.withColumns({"tier": F.lit("sensor"), "confidence": F.lit(0.9), "expires_at": F.col("observed_at") + F.expr("interval 15 minutes")}).drop("rank")


def fuse(observed: DataFrame, now: Column) -> DataFrame:
    """Per segment with an observation that lives: speed, ratio and level of the best tier's freshest speed (ties: the first source).

    The worst level among rows without a speed overrides it; a segment with such
    rows alone has no speed. sources names all that live.
    """
    live = observed.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    tier = F.coalesce(*[F.when(F.col("tier") == t, i) for i, t in enumerate(TIERS)], F.lit(len(TIERS)))
    first = Window.partitionBy("segment_id").orderBy(tier, F.desc("observed_at"), "source")
    speed = live.where("speed_kph is not null").withColumn("r", F.row_number().over(first)).where("r = 1")
    speed = speed.select("segment_id", "speed_kph", "free_flow_kph", "ratio", F.col("los").alias("speed_los"), F.col("source").alias("speed_source"), F.col("tier").alias("speed_tier"), F.col("observed_at").alias("speed_at"))
    silent = F.col("speed_kph").isNull() & (F.coalesce("los", F.lit("unknown")) != "unknown")
    g = live.groupBy("segment_id").agg(
        F.max(F.when(silent, los_rank("los"))).alias("rank"), F.max(F.when(silent, F.col("observed_at"))).alias("declared_at"),
        F.max(F.when(silent, F.struct("observed_at", "tier"))).alias("declared"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    j = g.join(speed, "segment_id", "left").where("rank is not null or speed_kph is not null")
    return j.select(
        "segment_id", "speed_kph", "free_flow_kph", "ratio", F.coalesce(los_of_rank(F.col("rank")), "speed_los").alias("los"), F.col("speed_source").alias("source"),
        F.coalesce("speed_tier", "declared.tier").alias("tier"), F.coalesce("speed_at", "declared_at").alias("observed_at"), "sources",
    )


def propagate(segments: DataFrame, speeds: DataFrame, within_m: float = 50, turn_deg: float = 60, longest_m: float = 3000, cell_deg: float = 0.002) -> DataFrame:
    """Speeds for segments without any, from a neighbour of the same road: one's end is near the other's start, either way round.

    The nearest by the lines' distance (straight lines; ties: the smaller id);
    the ratio is against the segment's own free flow. Ends meet in cells, so roads
    of very many segments are no all-pairs join.
    """
    cols = ["segment_id", "highway", "ref", "ax", "ay", "bx", "by"]
    src = speeds.where("speed_kph is not null").select("segment_id", "speed_kph").join(segments.select(*cols), "segment_id")
    src = src.select(F.col("segment_id").alias("from_id"), "speed_kph", "highway", "ref", *[F.col(c).alias(f"s{c}") for c in cols[3:]])
    dst = segments.join(speeds.select("segment_id"), "segment_id", "left_anti").where(F.col("length_m") <= longest_m)
    c = lambda x: F.floor(x / cell_deg)
    wide = F.ceil(F.lit(within_m) / (F.greatest(F.cos(F.radians("y")), F.lit(0.01)) * 111_194 * cell_deg)).cast("int")
    tall = math.ceil(within_m / (111_194 * cell_deg))

    def ends(df: DataFrame, x: str, y: str, forward: bool) -> DataFrame:
        return df.withColumns({"x": F.col(x), "y": F.col(y), "forward": F.lit(forward)})

    there = ends(src, "sbx", "sby", True).union(ends(src, "sax", "say", False)).withColumns({"cx": c(F.col("x")), "cy": c(F.col("y"))})
    there = there.withColumnsRenamed({"x": "sx", "y": "sy"})
    here = ends(dst, "ax", "ay", True).union(ends(dst, "bx", "by", False))
    here = here.withColumn("cx", F.explode(F.sequence(c(F.col("x")) - wide, c(F.col("x")) + wide))).withColumn("cy", F.explode(F.sequence(c(F.col("y")) - tall, c(F.col("y")) + tall)))
    j = here.join(there, ["highway", "ref", "forward", "cx", "cy"]).where((F.col("from_id") != F.col("segment_id")) & (haversine_m(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")) <= within_m))
    turn = F.abs(azimuth_deg(F.col("sax"), F.col("say"), F.col("sbx"), F.col("sby")) - azimuth_deg(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    j = j.where(F.least(turn, 360 - turn) <= turn_deg)
    pt = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    near = polyline_distance_m(F.array(pt("ax", "ay"), pt("bx", "by")), F.array(pt("sax", "say"), pt("sbx", "sby")))
    w = Window.partitionBy("segment_id").orderBy("near", "from_id")
    k = j.withColumn("near", F.round(near, 3)).withColumn("r", F.row_number().over(w)).where("r = 1")
    ratio = F.when(F.col("free_flow_kph") > 0, F.col("speed_kph") / F.col("free_flow_kph"))
    return k.select("segment_id", "from_id", "speed_kph", ratio.alias("ratio"), level_of_service(ratio).alias("los"))


def orphans(segments: DataFrame, ways: DataFrame) -> DataFrame:
    """Segments whose way is gone."""
    return segments.join(ways.select("way_id").distinct(), "way_id", "left_anti")


def import_guard(old_rows: int, new_rows: int, least_share: float = 0.9) -> str | None:
    """Why a region's import must not replace what is there, or None: it covers too little of it."""
    return "covers too little" if new_rows < least_share * old_rows else None


def maxspeed_fallback(sensors: DataFrame, baseline: DataFrame, limits: DataFrame, most: int) -> DataFrame:
    """Free flow from the road's speed limit for sensors without any baseline, the first ``most`` by key."""
    bare = sensors.select("sensor_key").distinct().join(baseline.select("sensor_key").distinct(), "sensor_key", "left_anti")
    return bare.join(limits.where("maxspeed_kph is not null"), "sensor_key").select("sensor_key", F.col("maxspeed_kph").alias("free_flow_kph"), F.lit("osm_maxspeed").alias("method")).orderBy("sensor_key").limit(most)


def overlay(segments: DataFrame, speeds: DataFrame, box: tuple[float, float, float, float], limit: int = 20_000) -> DataFrame:
    """Segments in the box with their speed if any, the first by id: what a map shows."""
    w, s, e, n = box
    inside = (F.greatest("ax", "bx") >= w) & (F.least("ax", "bx") <= e) & (F.greatest("ay", "by") >= s) & (F.least("ay", "by") <= n)
    return segments.where(inside).join(speeds, "segment_id", "left").orderBy("segment_id").limit(limit)


def tile(segments: DataFrame, speeds: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """What a map tile shows: segments due at its zoom whose envelope touches it, with their speed if any and their ends in the tile's units."""
    w, s, e, n = tile_envelope(z, x, y)
    inside = (F.greatest("ax", "bx") >= w) & (F.least("ax", "bx") <= e) & (F.greatest("ay", "by") >= s) & (F.least("ay", "by") <= n)
    ends = F.array(tile_position(F.col("ax"), F.col("ay"), z, x, y), tile_position(F.col("bx"), F.col("by"), z, x, y))
    return segments.where(inside & (F.col("min_zoom") <= z)).join(speeds, "segment_id", "left").withColumn("line", ends)


def without_regions(segments: DataFrame, ways: DataFrame, regions: list[str]) -> DataFrame:
    """Segments that stay when the given regions are built anew."""
    return segments.join(ways.where(F.col("region").isin(regions)).select("way_id").distinct(), "way_id", "left_anti")


def line_references(segments: DataFrame) -> DataFrame:
    """(segment_id, openlr) of segments without a reference (segment_id, highway, junction, oneway, ax, ay, bx, by, length_m, openlr): their ends as a line."""
    todo = segments.where("openlr is null").select("segment_id", road_class(F.col("highway")).alias("frc"), form_of_way(F.col("highway"), F.col("junction"), F.col("oneway")).alias("fow"), azimuth_deg(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("deg"), "ax", "ay", "bx", "by", "length_m")

    @F.pandas_udf("string")
    def write(rows: pd.DataFrame) -> pd.Series:
        made = []
        for r in rows.itertuples():
            a = openlr.Point(r.ax, r.ay, r.frc, r.fow, r.deg, r.frc, r.length_m)
            b = openlr.Point(r.bx, r.by, r.frc, r.fow, (r.deg + 180) % 360)
            made.append(base64.b64encode(openlr.encode([a, b])).decode() if max(abs(r.bx - r.ax), abs(r.by - r.ay)) < 0.32 and r.length_m < 15_000 else None)
        return pd.Series(made, dtype=object)

    out = todo.withColumn("openlr", write(F.struct("frc", "fow", "deg", "ax", "ay", "bx", "by", "length_m")))
    return out.where("openlr is not null").select("segment_id", "openlr")


def rebuild(steps: list[tuple[str, Callable[[], object]]]) -> dict[str, str | None]:
    """Run the steps in order, each on its own: a step that fails doesn't stop those after it. Errors by step."""
    errors: dict[str, str | None] = {}
    for name, step in steps:
        try:
            step()
            errors[name] = None
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {e}"
    return errors
