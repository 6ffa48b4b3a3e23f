"""Feed formats: landed text files to events and flows. One row per usable record; bad records are skipped one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MPH = 1.609344

PARSERS: dict[str, Callable[..., DataFrame]] = {}


def parser(name: str):
    def add(f):
        PARSERS[name] = f
        return f

    return add


def at(doc: str, path: str) -> Column:
    return F.get_json_object(F.col(doc), path)


def items(raw: DataFrame, path: str) -> DataFrame:
    """One row (doc) per element of the array at ``path`` of each landed document (value)."""
    return raw.select(F.explode(F.from_json(F.get_json_object("value", path), "array<string>")).alias("doc"))


def local_id(source: str, own: Column, *parts: Column) -> Column:
    """source:id; a record without an id is named by its content."""
    return F.concat(F.lit(f"{source}:"), F.coalesce(own, F.sha2(F.concat_ws("\x1f", *parts), 256)))


def first_position(doc: str, path: str) -> tuple[Column, Column]:
    """Longitude and latitude of a geometry's first position, whatever its depth."""
    text = F.regexp_extract(at(doc, path), r"\[\s*(-?[0-9.eE+]+\s*,\s*-?[0-9.eE+]+)", 1)
    xy = F.split(text, r"\s*,\s*")
    return F.try_element_at(xy, F.lit(1)).cast("double"), F.try_element_at(xy, F.lit(2)).cast("double")


@parser("geojson")
def mapped_geojson(raw: DataFrame, source: str, fields: dict[str, str], include: dict[str, list[str]] | None = None, exclude: dict[str, list[str]] | None = None, default_type: str = "other", path: str = "$.features") -> DataFrame:
    """Any feature collection by a map of names to dotted paths; include rejects missing values, exclude passes them."""
    f = items(raw, path)
    for p, values in (include or {}).items():
        f = f.where(at("doc", f"$.{p}").isin(values))
    for p, values in (exclude or {}).items():
        f = f.where(~F.coalesce(at("doc", f"$.{p}").isin(values), F.lit(False)))
    lon, lat = first_position("doc", "$.geometry.coordinates")
    got = f.select(local_id(source, at("doc", f"$.{fields['id']}") if "id" in fields else F.lit(None), F.col("doc")).alias("id"), F.lit(source).alias("source"), F.coalesce(at("doc", f"$.{fields['type']}") if "type" in fields else F.lit(None), F.lit(default_type)).alias("type"), lon.alias("lon"), lat.alias("lat"), *[at("doc", f"$.{p}").alias(n) for n, p in fields.items() if n not in ("id", "type")])
    return got.where("lon is not null and lat is not null").dropDuplicates(["id"])


@parser("open511")
def open511(raw: DataFrame, source: str) -> DataFrame:
    f = items(raw, "$.events")
    lon, lat = first_position("doc", "$.geography.coordinates")
    states = F.from_json(at("doc", "$.roads"), "array<struct<name:string,state:string,direction:string,lanes_closed:int,lanes_open:int>>")
    added = lambda k: F.when(F.exists(states, lambda r: r[k].isNotNull()), F.aggregate(states, F.lit(0), lambda s, r: s + F.coalesce(r[k], F.lit(0))))
    worst = F.when(F.exists(states, lambda r: r.state == "CLOSED"), "closed").when(F.exists(states, lambda r: r.state == "SOME_LANES_CLOSED"), "some_lanes_closed").when(F.exists(states, lambda r: r.state == "SINGLE_LANE_ALTERNATING"), "single_lane_alternating")
    directions = F.array_distinct(F.transform(states, lambda r: r.direction))
    interval = F.split(F.get_json_object("doc", "$.schedule.intervals[0]"), "/")
    return f.select(local_id(source, at("doc", "$.id"), F.col("doc")).alias("id"), F.lit(source).alias("source"), F.lower(at("doc", "$.event_type")).alias("type"), F.lower(at("doc", "$.severity")).alias("severity"), worst.alias("road_state"), added("lanes_closed").alias("lanes_closed"), added("lanes_open").alias("lanes_open"), F.when(F.size(directions) == 1, directions[0]).alias("direction"), F.try_element_at(interval, F.lit(1)).alias("valid_from"), F.try_element_at(interval, F.lit(2)).alias("valid_to"), at("doc", "$.headline").alias("headline"), lon.alias("lon"), lat.alias("lat")).where("lon is not null").dropDuplicates(["id"])


@parser("wzdx")
def wzdx(raw: DataFrame, source: str) -> DataFrame:
    """Version 4, and version 3 lifted where there are no core details."""
    f = items(raw, "$.features")
    core = lambda k: F.coalesce(at("doc", f"$.properties.core_details.{k}"), F.when(at("doc", "$.properties.core_details").isNull(), at("doc", f"$.properties.{k}")))
    lon, lat = first_position("doc", "$.geometry.coordinates")
    impact = at("doc", "$.properties.vehicle_impact")
    state = F.when(impact == "all-lanes-closed", "closed").when(impact.isin("some-lanes-closed", "some-lanes-closed-merge-left", "some-lanes-closed-merge-right"), "some_lanes_closed").when(impact == "alternating-one-way", "single_lane_alternating")
    status = F.when(at("doc", "$.properties.event_status") == "completed", "archived").otherwise("active")
    return f.select(local_id(source, F.concat_ws("-", core("data_source_id"), F.coalesce(at("doc", "$.id"), core("road_event_id"))), F.col("doc")).alias("id"), F.lit(source).alias("source"), core("event_type").alias("type"), status.alias("status"), state.alias("road_state"), at("doc", "$.properties.start_date").alias("valid_from"), at("doc", "$.properties.end_date").alias("valid_to"), lon.alias("lon"), lat.alias("lat")).where("lon is not null").dropDuplicates(["id"])


@parser("measured")
def measured_sites(rows: DataFrame) -> DataFrame:
    """Best sample per site of (site, speed, inputs, free_flow, ord, error): no error, plausible, most inputs, the first of equals; the first free flow."""
    ok = rows.where("not coalesce(error, false) and speed >= 0 and speed < 250 and inputs > 0")
    best = F.max(F.struct("inputs", (-F.col("ord")).alias("o"), "speed")).alias("x")
    return ok.groupBy("site").agg(best, F.min(F.when(F.col("free_flow").isNotNull(), F.struct("ord", "free_flow"))).alias("f")).select("site", F.col("x.speed").alias("speed_kph"), F.col("f.free_flow").alias("free_flow_kph"))


@parser("latest")
def latest_per_site(rows: DataFrame, site: str, order: str, speed_mph: str) -> DataFrame:
    """The latest row per site by the text order of its time; miles to kilometres."""
    return rows.groupBy(site).agg(F.max(F.struct(order, speed_mph)).alias("x")).select(site, (F.col(f"x.{speed_mph}") * MPH).alias("speed_kph"))


@parser("lanes")
def weighted_lanes(rows: DataFrame) -> DataFrame:
    """Mean over valid lanes weighted by volume, plain without any volume."""
    ok = rows.where("valid and speed is not null")
    return ok.groupBy("site").agg(F.coalesce(F.try_divide(F.sum(F.col("speed") * F.col("volume")), F.sum("volume")), F.avg("speed")).alias("speed_kph"))


@parser("bands")
def speed_bands(rows: DataFrame) -> DataFrame:
    return rows.select("link", ((F.col("low") + F.col("high")) / 2).alias("speed_kph"))


@parser("overpass")
def overpass_ways(raw: DataFrame) -> DataFrame:
    f = items(raw, "$.elements").where(at("doc", "$.type") == "way")
    coords = F.transform(F.from_json(at("doc", "$.geometry"), "array<struct<lon:double,lat:double>>"), lambda p: F.struct(p.lon.alias("lon"), p.lat.alias("lat")))
    return f.select(at("doc", "$.id").cast("long").alias("way_id"), at("doc", "$.tags.highway").alias("highway"), at("doc", "$.tags.ref").alias("ref"), at("doc", "$.tags.maxspeed").alias("maxspeed"), F.coalesce(at("doc", "$.tags.oneway").isin("yes", "1", "-1", "true"), F.lit(False)).alias("oneway"), coords.alias("coords")).where("size(coords) >= 2")


@parser("site_xml")
def measured_xml(spark, path: str) -> DataFrame:
    """Site measurements of a large XML file, cut at the record's tag."""
    return spark.read.format("xml").option("rowTag", "siteMeasurements").load(path)


def layered(registry: DataFrame) -> DataFrame:
    """Feeds of several layers (id, layer, slot, …): the last layer's values, the first slot."""
    rest = [c for c in registry.columns if c not in ("id", "layer", "slot")]
    return registry.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("layer")).alias("x"), F.min("slot").alias("slot")).select("id", "slot", *[F.col(f"x.{c}").alias(c) for c in rest])
