"""Emitters: GeoJSON, JSON-LD, XML, speed CSV, routing exclusions, archives, event frames, consumer rows."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import geometry
from wayloom.operators.changes import guard_swap
from wayloom.operators.read import CLOSURES, excludable


def geojson_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """One feature per row as text; a collection is the concatenation of partitions, never a driver's string."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def bounds_of(rows: DataFrame, points: str) -> DataFrame:
    """The box of all positions of all rows."""
    e = rows.select(geometry.envelope(F.col(points)).alias("e"))
    return e.agg(F.min("e.west").alias("west"), F.min("e.south").alias("south"), F.max("e.east").alias("east"), F.max("e.north").alias("north"))


def collection_lines(features: DataFrame, box: DataFrame) -> DataFrame:
    """(ord, value): a feature collection's text as lines, its head with the box, its features, its tail; written in order by ``ord``."""
    head = box.select(F.lit(0).alias("ord"), F.concat(F.lit('{"type":"FeatureCollection","bbox":'), F.to_json(F.array("west", "south", "east", "north")), F.lit(',"features":[')).alias("value"))
    own = features.select(F.lit(1).alias("ord"), "value")
    tail = box.select(F.lit(2).alias("ord"), F.lit("]}").alias("value"))
    return head.union(own).union(tail)


def json_ld(rows: DataFrame, context: str, kind: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit(context).alias("@context"), F.lit(kind).alias("@type"), F.col("id").alias("@id"), *[c for c in rows.columns if c != "id"])).alias("value"))


def escaped(c: Column) -> Column:
    out = c.cast("string")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def xml_element(tag: str, children: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *[F.when(c.isNotNull(), F.concat(F.lit(f"<{n}>"), escaped(c), F.lit(f"</{n}>"))).otherwise(F.lit("")) for n, c in children], F.lit(f"</{tag}>"))


# TraFF's classes and types of events, and of restrictions by the state of the road and by dimension.
TRAFF = {
    "accident": "INCIDENT INCIDENT_ACCIDENT", "broken_down_vehicle": "INCIDENT INCIDENT_BROKEN_DOWN_VEHICLE", "roadworks": "CONSTRUCTION CONSTRUCTION_ROADWORKS", "congestion": "CONGESTION CONGESTION_TRAFFIC_CONGESTION",
    "hazard": "HAZARD HAZARD_HAZARD", "obstruction": "HAZARD HAZARD_OBSTRUCTION", "road_condition": "HAZARD HAZARD_HAZARD", "weather": "HAZARD HAZARD_HAZARD", "public_event": "ACTIVITY ACTIVITY_EVENT",
    "authority": "AUTHORITY AUTHORITY_CHECKPOINT", "security": "SECURITY SECURITY_ALERT", "speed_restriction": "RESTRICTION RESTRICTION_SPEED_LIMIT", "road_closure": "RESTRICTION RESTRICTION_CLOSED",
    "lane_closure": "RESTRICTION RESTRICTION_LANE_CLOSED", "contraflow": "RESTRICTION RESTRICTION_CONTRAFLOW",
}
TRAFF_STATES = {"closed": "RESTRICTION RESTRICTION_CLOSED", "some_lanes_closed": "RESTRICTION RESTRICTION_LANE_CLOSED", "single_lane_alternating": "RESTRICTION RESTRICTION_CONTRAFLOW"}
TRAFF_DIMENSIONS = ["height", "width", "length", "weight"]


def traff_messages(rows: DataFrame) -> DataFrame:
    """(id, value): a TraFF message for each event (id, type, severity, road_state, dimension, road, direction, points, updated_at, valid_from, valid_to, expires_at).

    The event's own code, then its road state's unless it is the same; traffic
    congestion where neither is known. Lines go from their first position to their last.
    """
    known = lambda words, c: F.coalesce(*[F.when(c == k, v) for k, v in words.items()])
    size = F.when(F.col("type") == "dimension_restriction", F.concat(F.lit("RESTRICTION RESTRICTION_MAX_"), F.upper(F.when(F.col("dimension").isin(TRAFF_DIMENSIONS), F.col("dimension")).otherwise("weight"))))
    codes = F.array_distinct(F.array_compact(F.array(F.coalesce(size, known(TRAFF, F.col("type"))), known(TRAFF_STATES, F.col("road_state")))))
    codes = F.when(F.size(codes) == 0, F.array(F.lit("CONGESTION CONGESTION_TRAFFIC_CONGESTION"))).otherwise(codes)
    event = F.array_join(F.transform(codes, lambda c: F.concat(F.lit('<event class="'), F.split(c, " ")[0], F.lit('" type="'), F.split(c, " ")[1], F.lit('"/>'))), "")
    signed = lambda n: F.concat(F.when(n >= 0, "+").otherwise(""), n.cast("string"))
    coord = lambda p: F.concat(signed(p.lat), F.lit(" "), signed(p.lon))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    attr = lambda n, c: F.coalesce(F.concat(F.lit(f' {n}="'), escaped(c), F.lit('"')), F.lit(""))
    line = F.size("points") >= 2
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    place = F.when(line, F.concat(F.lit("<from>"), coord(first), F.lit("</from><to>"), coord(last), F.lit("</to>"))).otherwise(F.concat(F.lit("<at>"), coord(first), F.lit("</at>")))
    location = F.concat(F.lit("<location"), attr("road_ref", F.col("road")), attr("direction", F.col("direction")), F.when(line, ' directionality="ONE_DIRECTION"').otherwise(""), F.lit(">"), place, F.lit("</location>"))
    urgency = F.when(F.col("severity") == "critical", "X_URGENT").when(F.col("severity") == "high", "URGENT").otherwise("NORMAL")
    head = F.concat(F.lit('<message id="'), escaped(F.col("id")), F.lit('"'), attr("receive_time", iso("updated_at")), attr("update_time", iso("updated_at")), attr("urgency", urgency), attr("expiration_time", iso(F.coalesce("expires_at", "valid_to"))), attr("start_time", iso("valid_from")), attr("end_time", iso("valid_to")), F.lit(">"))
    return rows.where("size(points) > 0").select("id", F.concat(head, F.lit("<events>"), event, F.lit("</events>"), location, F.lit("</message>")).alias("value"))


def situation_records(rows: DataFrame) -> DataFrame:
    """One DATEX II situation per event: rows that aren't active are suspended; without a confidence a forecast is a risk, all else certain; the place is the first position."""
    known = F.when(F.col("confidence") == "observed", "certain").when(F.col("confidence") == "likely", "probable").when(F.col("confidence") == "possible", "riskOf").when(F.col("confidence") == "unknown", "improbable")
    probability = F.coalesce(known, F.when(F.coalesce("is_forecast", F.lit(False)), "riskOf").otherwise("certain"))
    status = F.when(F.col("status") == "active", "active").otherwise("suspended")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    place = F.concat(F.lit("<locationReference><pointByCoordinates><pointCoordinates><latitude>"), F.col("points")[0].lat.cast("string"), F.lit("</latitude><longitude>"), F.col("points")[0].lon.cast("string"), F.lit("</longitude></pointCoordinates></pointByCoordinates></locationReference>"))
    times = F.concat(F.lit("<validity><validityStatus>"), status, F.lit("</validityStatus><validityTimeSpecification>"), F.coalesce(F.concat(F.lit("<overallStartTime>"), iso("valid_from"), F.lit("</overallStartTime>")), F.lit("")), F.coalesce(F.concat(F.lit("<overallEndTime>"), iso("valid_to"), F.lit("</overallEndTime>")), F.lit("")), F.lit("</validityTimeSpecification></validity>"))
    record = F.concat(F.lit('<situationRecord id="'), escaped(F.col("id")), F.lit('"><probabilityOfOccurrence>'), probability, F.lit("</probabilityOfOccurrence>"), times, place, F.lit("</situationRecord>"))
    return rows.where("size(points) > 0").select("id", F.concat(F.lit('<situation id="'), escaped(F.col("id")), F.lit('"><overallSeverity>'), escaped(F.coalesce("severity", F.lit("unknown"))), F.lit("</overallSeverity>"), record, F.lit("</situation>")).alias("value"))


def speed_csv(segments: DataFrame) -> DataFrame:
    """Lines way_id,dir,current_kph,free_flow_kph,los of segments with a speed; a missing free flow is empty."""
    own = F.concat_ws(",", F.col("way_id").cast("string"), "dir", F.col("speed_kph").cast("string"), F.coalesce(F.col("free_flow_kph").cast("string"), F.lit("")), "los")
    return segments.where("speed_kph is not null").select(own.alias("value"))


def exclusions(rows: DataFrame, at: Column, spacing_m: float = 45.0, most: int = 200, overall: int = 45) -> DataFrame:
    """(k, lon, lat): the points that routing avoids at a time, of all closures together at most ``overall``, evenly.

    rows: events as of read.excludable, with id and points (null for areas, see avoided_rings). Points of a closure's
    line are at most ``spacing_m`` apart, and of more than ``most`` every so many.
    """
    pts = rows.where(excludable(at)).select("id", F.posexplode(geometry.densified(F.col("points"), spacing_m, most)).alias("pos", "p"))
    n = pts.count()
    counts = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = pts.groupBy("id").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(counts), F.lit(0))).select("id", "before")
    numbered = pts.join(ahead, "id").withColumn("i", F.col("before") + F.col("pos"))
    if n <= overall:
        return numbered.select(F.col("i").alias("k"), "p.lon", "p.lat")
    stride = n / overall
    picked = rows.sparkSession.range(overall).select(F.col("id").alias("k"), F.floor(F.col("id") * F.lit(stride)).alias("i"))
    return numbered.join(F.broadcast(picked), "i").select("k", "p.lon", "p.lat")


def avoided_rings(rows: DataFrame, at: Column) -> DataFrame:
    """(id, ring): outer rings of the closures that are areas."""
    own = rows.where(excludable(at) & F.col("type").isin(CLOSURES) & geometry.kind_of(F.col("geometry")).isin("Polygon", "MultiPolygon"))
    return own.select("id", F.explode(geometry.rings(F.col("geometry"))).alias("ring")).where("size(ring) >= 3")


def permissive(rows: DataFrame, share_alike: list[str]) -> DataFrame:
    """Without rows under share-alike licences, and without the reporter and the merged sources under such licences of what is left."""
    bad = lambda c: reduce_or([F.lower(F.coalesce(c, F.lit(""))).contains(s) for s in share_alike])
    out = rows.where(~bad(F.col("license")))
    if "merged_sources" in out.columns:
        out = out.withColumn("merged_sources", F.filter("merged_sources", lambda m: ~bad(m["license"])))
    return out.drop("reporter") if "reporter" in out.columns else out


def reduce_or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that occur in ``df``: the swap of one source."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def swap(old: DataFrame | None, new: DataFrame, path: str, is_flow: bool, failed: int = 0, fetched: int = 0, by: str = "source") -> str | None:
    """Replace what is there of the sources in ``new``, unless a guard refuses: its reason, or None when done."""
    why = guard_swap(0 if old is None else old.count(), new.count(), is_flow, failed, fetched)
    if why is None:
        write_partitioned(new, path, by)
    return why


def wkb_point(lon: Column, lat: Column) -> Column:
    """Little-endian WKB of points, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y)], dtype=object)

    return run(lon, lat)


def geoparquet(rows: DataFrame, folder: str, open_output: Callable[[str], object]) -> DataFrame:
    """Write Parquet files with a WKB column ``geometry`` and the ``geo`` entry in their footers; (path, rows) of each.

    rows: (…, geometry: binary). Each task writes files under names of its own;
    only those returned count, so tasks can be retried. open_output opens a path
    of the shared store for writing.
    """
    meta = b'{"version":"1.0.0","primary_column":"geometry","columns":{"geometry":{"encoding":"WKB","geometry_types":[]}}}'

    def run(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq

        writer, path, n = None, f"{folder}/part-{uuid.uuid4().hex}.parquet", 0
        for batch in batches:
            schema = batch.schema.with_metadata({**(batch.schema.metadata or {}), b"geo": meta})
            if writer is None:
                out = open_output(path)
                writer = pq.ParquetWriter(out, schema)
            writer.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=schema))
            n += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "rows": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "path string, rows long")


def sse_frames(changes: DataFrame) -> DataFrame:
    return changes.select(F.concat(F.lit("event: "), F.col("change"), F.lit("\ndata: "), F.to_json(F.struct(*changes.columns)), F.lit("\n\n")).alias("value"))


def delta(before: DataFrame, now: DataFrame, key: str, signature: str) -> DataFrame:
    """(key, change): changed for rows that are new or have another signature, removed for rows that are gone."""
    a, b = before.select(F.col(key).alias("ka"), F.col(signature).alias("sa")), now.select(F.col(key).alias("kb"), F.col(signature).alias("sb"))
    j = a.join(b, a.ka == b.kb, "full").where("kb is null or ka is null or not (sa <=> sb)")
    return j.select(F.coalesce("kb", "ka").alias(key), F.when(F.col("kb").isNull(), "removed").otherwise("changed").alias("change"))


def consumer_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, flows) as a consumer takes them: live rows by kind, flows with their ratio."""
    live = rows.where("status = 'active'")
    events = live.where("kind = 'event'").select("id", "source", "type", "severity", "headline", "valid_from", "valid_to", "points")
    flows = live.where("kind = 'measurement'").select("id", "source", "speed_kph", "free_flow_kph", F.when(F.col("free_flow_kph") > 0, F.col("speed_kph") / F.col("free_flow_kph")).alias("ratio"), "los", "points")
    return events, flows
