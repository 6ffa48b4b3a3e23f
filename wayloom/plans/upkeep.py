"""Queries on filters, upkeep, parsers and emitters of the older kind, event feeds and road networks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geometry, scalars
from wayloom.operators import changes, read, resolution, segments, speed
from wayloom.plans.adapters import BINS, OBS, OBS_NOW, SAMPLES, Tables, haversine
from wayloom.plans.registry import query
from wayloom.sinks import emit
from wayloom.sources import datex, events, formats, openlr, roads
from wayloom.streaming import jobs

XY = "round(4 + s_suppkey % 90 * 0.01::DOUBLE, 6) AS lon, round(50 + s_suppkey % 70 * 0.01::DOUBLE, 6) AS lat"


def key():
    return F.col("s_suppkey")


def obs_now():
    return F.lit(OBS_NOW).cast("timestamp")


def xy():
    return F.round(4 + key() % 90 * 0.01, 6).cast("string"), F.round(50 + key() % 70 * 0.01, 6).cast("string")


def documents(rows: DataFrame, element, head: str, tail: str) -> DataFrame:
    return rows.groupBy((key() % 8).alias("doc")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(element), ","), F.lit(tail)).alias("value")).select("value")


def first_point(e: DataFrame) -> DataFrame:
    return e.withColumns({"lon": F.round(F.col("points")[0].lon, 6), "lat": F.round(F.col("points")[0].lat, 6)}).drop("points")


# --- filters and upkeep ------------------------------------------------------


@query(f"WITH {OBS} SELECT id FROM obs WHERE status = 'active' AND valid_to > now AND (expires_at IS NULL OR expires_at > now) AND type IN ('O', 'P') AND id % 3 <> 0 AND lon BETWEEN 4::DOUBLE AND 6::DOUBLE AND lat BETWEEN 50::DOUBLE AND 52::DOUBLE AND (valid_from <= now + INTERVAL 7 DAY) AND rank >= 2 AND NOT (origin_kind = 'crowd' AND NOT routing_eligible) ORDER BY rank DESC, id LIMIT 300")
def read_all_filters(t: Tables) -> DataFrame:
    o = t.obs().withColumns({"domain": F.lit("roads"), "kind": F.when(F.col("id") % 3 == 0, "measurement").otherwise("event")})
    return read.read_live(o.where("domain = 'roads' and kind = 'event'"), read.checked_bbox(4, 50, 6, 52), obs_now(), types=["O", "P"], least="medium", horizon_days=7, routing_only=True, limit=300).select("id")


@query(f"WITH {OBS} SELECT id, epoch(now) - epoch(valid_from) >= (id % 900) * 86400 AS stale FROM obs")
def record_age_staleness(t: Tables) -> DataFrame:
    return t.obs().select("id", read.record_stale(F.col("valid_from"), F.col("id") % 900 * 86400, obs_now()).alias("stale"))


@query(f"""WITH {SAMPLES}, f AS (SELECT sensor_key, observed_at, speed_kph, CASE WHEN sensor_key % 2 = 0 THEN 'unknown' ELSE 'heavy' END AS los, CASE WHEN sensor_key % 6 = 0 THEN 50.0::DOUBLE END AS ff FROM samples),
b AS (SELECT DISTINCT sensor_key, 100.0::DOUBLE AS base FROM f WHERE sensor_key % 4 <> 0), j AS (SELECT f.*, base, f.los = 'unknown' AND ff IS NULL AND base > 0 AS use FROM f LEFT JOIN b USING (sensor_key))
SELECT sensor_key, floor(epoch(observed_at))::BIGINT AS at_s, speed_kph, CASE WHEN NOT coalesce(use, FALSE) THEN los WHEN speed_kph / base >= 0.85 THEN 'free_flow' WHEN speed_kph / base >= 0.5 THEN 'heavy' WHEN speed_kph / base >= 0.15 THEN 'queuing' ELSE 'stationary' END AS los, CASE WHEN coalesce(use, FALSE) THEN base ELSE ff END AS free_flow_kph FROM j""")
def flows_reclassified(t: Tables) -> DataFrame:
    k = F.col("sensor_key")
    f = t.samples().select("sensor_key", "observed_at", "speed_kph", F.when(k % 2 == 0, "unknown").otherwise("heavy").alias("los"), F.when(k % 6 == 0, 50.0).alias("free_flow_kph"))
    b = f.where("sensor_key % 4 <> 0").select("sensor_key").distinct().withColumn("free_flow_kph", F.lit(100.0))
    return read.reclassified(f, b).select("sensor_key", F.unix_seconds("observed_at").alias("at_s"), "speed_kph", "los", "free_flow_kph")


@query("SELECT o_orderkey AS id FROM orders WHERE (o_orderkey + 3 IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)) AND o_custkey % 4 = (SELECT any_value(p.o_custkey % 4) FROM orders p WHERE p.o_orderkey = orders.o_orderkey + 3)")
def superseded_rows(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    o = t.read("orders").select(k.alias("id"), (F.col("o_custkey") % 4).alias("instance"), F.when(k % 5 == 0, F.array(k - 3)).otherwise(F.array().cast("array<long>")).alias("replaces"))
    return changes.supersede(o)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-20' - INTERVAL 37 DAY")
def journal_retained(t: Tables) -> DataFrame:
    return changes.retained(t.events().withColumnRenamed("ts", "created_at"), F.lit("2024-02-20").cast("timestamp"), 10).select("event_id")


@query("""WITH c AS (SELECT c_custkey AS idx, 's' || (c_custkey % 2) AS source, c_mktsegment AS type, c_custkey // 4 AS g, c_custkey % 7 AS u FROM customer WHERE c_custkey % 4 < 2 OR c_custkey % 4 = 3),
k AS (SELECT *, CASE WHEN c.idx % 4 = 3 THEN 1 ELSE 0 END AS apart FROM c)
SELECT idx FROM (SELECT *, row_number() OVER (PARTITION BY g, source, type, apart ORDER BY u DESC, idx) AS n FROM k) WHERE n = 1""")
def same_source_dedup(t: Tables) -> DataFrame:
    """Of reports of one source and type at one place whose texts agree, the newest; a place is a customer's group of four, one of which says something else."""
    k = F.col("c_custkey")
    g = F.floor(k / 4)
    label = F.when(k % 4 == 3, "fallen tree").otherwise("big road works here")
    rows = t.read("customer").where("c_custkey % 4 <> 2").select(k.alias("idx"), (F.lit(4.0) + g % 300 * 0.01).alias("lon"), (F.lit(50.0) + F.floor(g / 300) * 0.01).alias("lat"), F.col("c_mktsegment").alias("type"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("source"), label.alias("label"), (k % 7).alias("updated_at"))
    return resolution.deduplicated(rows).select("idx")


@query("SELECT o_custkey AS id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS lineage FROM orders GROUP BY 1")
def lineage_unions(t: Tables) -> DataFrame:
    o = t.read("orders").select(F.col("o_custkey").alias("id"), F.array("o_orderpriority").alias("a"))
    g = o.groupBy("id").agg(F.collect_list("a").alias("all"))
    return g.select("id", F.array_join(F.array_sort(F.aggregate("all", F.array().cast("array<string>"), lambda s, a: F.array_union(s, a))), ",").alias("lineage"))


@query("SELECT user_id % 50 AS id, i::INTEGER AS i, round(sum(value * i), 4) AS total FROM events, (VALUES (0), (1), (2)) v(i) GROUP BY 1, 2")
def vector_sums(t: Tables) -> DataFrame:
    """Element-wise sums of vectors, combined before the shuffle."""
    v = t.events().select((F.col("user_id") % 50).alias("id"), F.posexplode(F.array(F.lit(0.0), F.col("value"), F.col("value") * 2)).alias("i", "x"))
    return v.groupBy("id", "i").agg(F.round(F.sum("x"), 4).alias("total"))


@query(f"WITH {BINS} SELECT sensor_key, epoch(hour)::BIGINT AS hour, bin, c FROM bins")
def histograms_unnested(t: Tables) -> DataFrame:
    return speed.unnested(speed.hourly_histogram(t.samples())).select("sensor_key", F.unix_seconds("hour").alias("hour"), "bin", "c")


@query("""SELECT s_suppkey, 2 + s_suppkey % 3 AS n, s_suppkey % 3 = 0 AS none, s_suppkey % 2 = 0 AS has_b, '{"id":' || s_suppkey || '}' AS kept FROM supplier""")
def json_guards(t: Tables) -> DataFrame:
    """Lengths of arrays, containment, and a document without one of its keys."""
    k = key()
    doc = F.to_json(F.struct(F.array_repeat(F.lit("x"), (2 + k % 3).cast("int")).alias("chain"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("tags"), F.struct(k.alias("id"), F.lit("r").alias("reporter")).alias("origin")))
    d = t.read("supplier").select("s_suppkey", doc.alias("doc"))
    n = F.json_array_length(F.get_json_object("doc", "$.chain"))
    origin = F.from_json(F.get_json_object("doc", "$.origin"), "struct<id:long,reporter:string>")
    return d.select("s_suppkey", n.cast("long").alias("n"), (n == 2).alias("none"), F.array_contains(F.from_json(F.get_json_object("doc", "$.tags"), "array<string>"), "b").alias("has_b"), F.to_json(origin.dropFields("reporter")).alias("kept"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 90 * 0.1 < 3 THEN 'Europe/London' WHEN s_suppkey % 90 * 0.1 < 7 THEN 'Europe/Amsterdam' END AS tz FROM supplier""")
def zones_by_place(t: Tables) -> DataFrame:
    """Time zones from a table of regions' boxes; the first that holds the place."""
    boxes = t.spark.createDataFrame([(1, 0.0, 49.0, 3.0, 52.0, "Europe/London"), (2, 2.0, 49.0, 7.0, 54.0, "Europe/Amsterdam")], "ord int, west double, south double, east double, north double, tz string")
    p = t.read("supplier").select("s_suppkey", (key() % 90 * 0.1).alias("lon"), F.lit(51.0).alias("lat"))
    return resolution.zoned(p, boxes).select("s_suppkey", "tz")


@query("SELECT feed AS id, slot, 'u' || top AS url FROM (SELECT s_suppkey % 20 AS feed, min(s_suppkey) AS slot, max(s_suppkey % 3) AS top FROM supplier GROUP BY 1)")
def layered_registry(t: Tables) -> DataFrame:
    r = t.read("supplier").select((key() % 20).alias("id"), (key() % 3).alias("layer"), key().alias("slot"), F.concat(F.lit("u"), (key() % 3).cast("string")).alias("url"))
    return formats.layered(r).select("id", "slot", "url")


@query("""SELECT s_suppkey, '{"a":{"x":1,"y":[{"b":2,"c":"é"}]},"z":' || s_suppkey || '}' AS canonical, sha256('{"a":{"x":1,"y":[{"b":2,"c":"é"}]},"z":' || s_suppkey || '}') AS content_hash FROM supplier""")
def nested_content_hash(t: Tables) -> DataFrame:
    c = changes.sorted_json(F.format_string('{"z":%d,"n":null,"a":{"y":[{"c":"é","b":2}],"x":1}}', key()))
    return t.read("supplier").select("s_suppkey", c.alias("canonical")).withColumn("content_hash", F.sha2("canonical", 256))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS lanes, 'd' || o_custkey AS direction FROM orders")
def attributes_round_trip(t: Tables) -> DataFrame:
    o = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("lanes"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("direction"))
    return changes.projected(changes.stored(o, ["id", "status"]), {"lanes": "long", "direction": "string", "status": "string"})


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 1000")
def prune_oldest(t: Tables) -> DataFrame:
    return changes.prune_batch(t.events().where("ts < timestamp '2024-01-20'"), "ts", "event_id", 1000).select("event_id")


# --- older parsers and emitters ----------------------------------------------


@query(f"""SELECT 'bc:' || s_suppkey AS id, CASE s_suppkey % 4 WHEN 1 THEN 'some_lanes_closed' WHEN 2 THEN 'closed' WHEN 3 THEN 'single_lane_alternating' END AS road_state, CASE WHEN s_suppkey % 2 = 0 THEN 'N' END AS direction, '2024-01-01T00:00' AS valid_from, {XY}, CASE WHEN s_suppkey % 5 > 0 THEN 3 + s_suppkey % 5 END AS lanes_closed FROM supplier""")
def open511_events(t: Tables) -> DataFrame:
    x, y = xy()
    state = lambda s: F.concat(F.lit('{"name":"A","state":"'), s, F.lit('","direction":"N","lanes_closed":3},'))
    one = F.element_at(F.array(*[F.lit(v) for v in ("ALL_LANES_OPEN", "SOME_LANES_CLOSED", "CLOSED", "SINGLE_LANE_ALTERNATING")]), (key() % 4 + 1).cast("int"))
    lanes = F.when(key() % 5 > 0, F.concat(F.lit(',"lanes_closed":'), (key() % 5).cast("string"))).otherwise("")
    second = F.concat(F.lit('{"name":"B","state":"ALL_LANES_OPEN","direction":"'), F.when(key() % 2 == 0, "N").otherwise("S"), F.lit('"'), lanes, F.lit("}"))
    first = F.when(key() % 5 > 0, state(one)).otherwise(F.replace(state(one), F.lit(',"lanes_closed":3'), F.lit("")))
    s = F.concat(F.format_string('{"id":"%d","event_type":"INCIDENT","severity":"MAJOR","geography":{"type":"Point","coordinates":[%s,%s]},"schedule":{"intervals":["2024-01-01T00:00/2024-02-01T00:00"]},"roads":[', key(), x, y), first, second, F.lit("]}"))
    e = formats.open511(documents(t.read("supplier"), s, '{"events":[', "]}"), "bc")
    return e.select("id", "road_state", "direction", "valid_from", "lon", "lat", F.col("lanes_closed").cast("long").alias("lanes_closed"))


@query(f"""SELECT 'us:src-' || s_suppkey AS id, 'work-zone' AS type, CASE WHEN s_suppkey % 3 = 0 THEN 'archived' ELSE 'active' END AS status, CASE s_suppkey % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'some_lanes_closed' WHEN 2 THEN 'single_lane_alternating' END AS road_state, {XY} FROM supplier""")
def wzdx_events(t: Tables) -> DataFrame:
    """Every second feature is of version 3, without core details."""
    x, y = xy()
    impact = F.element_at(F.array(*[F.lit(v) for v in ("all-lanes-closed", "some-lanes-closed", "alternating-one-way", "all-lanes-open")]), (key() % 4 + 1).cast("int"))
    core = F.when(key() % 2 == 0, F.lit('"core_details":{"event_type":"work-zone","data_source_id":"src"}')).otherwise(F.lit('"event_type":"work-zone","data_source_id":"src"'))
    s = F.concat(F.format_string('{"id":"%d","properties":{', key()), core, F.format_string(',"vehicle_impact":"%s","event_status":"%s","start_date":"a"},"geometry":{"type":"LineString","coordinates":[[%s,%s],[5,51]]}}', impact, F.when(key() % 3 == 0, "completed").otherwise("active"), x, y))
    return formats.wzdx(documents(t.read("supplier"), s, '{"features":[', "]}"), "us").select("id", "type", "status", "road_state", "lon", "lat")


@query(f"SELECT 'x:' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'roadworks' ELSE 'other' END AS type, 'n' || s_suppkey AS headline, {XY} FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def mapped_features(t: Tables) -> DataFrame:
    """Included kinds alone, an excluded state missing from most."""
    x, y = xy()
    kind = F.when(key() % 3 == 0, F.lit('"kind":"other",')).otherwise('"kind":"works",')
    gone = F.when(key() % 5 == 0, F.lit('"state":"over",')).otherwise("")
    name = F.when(key() % 2 == 0, F.lit('"t":"roadworks",')).otherwise("")
    s = F.concat(F.lit('{"properties":{'), kind, gone, name, F.format_string('"n":"n%d","k":%d},"geometry":{"type":"Point","coordinates":[%s,%s]}}', key(), key(), x, y))
    return formats.mapped_geojson(documents(t.read("supplier"), s, '{"features":[', "]}"), "x", {"id": "properties.k", "type": "properties.t", "headline": "properties.n"}, include={"properties.kind": ["works"]}, exclude={"properties.state": ["over"]}).drop("source")


@query("SELECT user_id AS site, max((strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), value))[2] * 1.609344::DOUBLE AS speed_kph FROM events GROUP BY 1")
def latest_per_site(t: Tables) -> DataFrame:
    return formats.latest_per_site(t.events().select(F.col("user_id").alias("site"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "value"), "site", "at", "value")


@query("SELECT user_id AS site, round(CASE WHEN sum(v) > 0 THEN sum(value * v) / sum(v) ELSE avg(value) END, 6) AS speed_kph FROM (SELECT user_id, value, CASE WHEN user_id % 4 = 0 THEN 0 ELSE event_id % 5 END AS v FROM events WHERE event_type <> 'error') GROUP BY 1")
def lanes_weighted(t: Tables) -> DataFrame:
    r = t.events().select(F.col("user_id").alias("site"), F.col("value").alias("speed"), F.when(F.col("user_id") % 4 == 0, 0).otherwise(F.col("event_id") % 5).alias("volume"), (F.col("event_type") != "error").alias("valid"))
    return formats.weighted_lanes(r).select("site", F.round("speed_kph", 6).alias("speed_kph"))


@query(f"""WITH {OBS} SELECT '{{"type":"Feature","id":' || id || ',"geometry":{{"type":"Point","coordinates":[' || (id % 90) || '.5,' || (id % 40) || '.25]}},"properties":{{"severity":"' || severity || '"}}}}' AS value FROM obs""")
def features_as_text(t: Tables) -> DataFrame:
    o = t.obs().select("id", "severity", (F.col("id") % 90 + 0.5).alias("lon"), (F.col("id") % 40 + 0.25).alias("lat"))
    return emit.geojson_features(o, ["severity"])


@query(f"""WITH {OBS} SELECT '{{"@context":"https://c","@type":"RoadEvent","@id":' || id || ',"severity":"' || severity || '"}}' AS value FROM obs""")
def linked_data(t: Tables) -> DataFrame:
    return emit.json_ld(t.obs().select("id", "severity"), "https://c", "RoadEvent")


@query("SELECT 4.0::DOUBLE AS west, 50.0::DOUBLE AS south, max(4.0 + s_suppkey % 9 + 0.5)::DOUBLE AS east, max(50.0 + s_suppkey % 5 + 0.25)::DOUBLE AS north FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT 0)")
def global_box(t: Tables) -> DataFrame:
    s = t.read("supplier").select("s_suppkey").union(t.spark.range(1))
    line = F.array(F.struct((4.0 + key() % 9).alias("lon"), (50.0 + key() % 5).alias("lat")), F.struct((4.5 + key() % 9).alias("lon"), (50.25 + key() % 5).alias("lat")))
    return emit.bounds_of(s.select(line.alias("points")), "points")


@query("SELECT s_suppkey || ',f,' || (s_suppkey % 80) || '.5,' || CASE WHEN s_suppkey % 2 = 0 THEN '100.0' ELSE '' END || ',heavy' AS value FROM supplier WHERE s_suppkey % 3 <> 0")
def speed_lines(t: Tables) -> DataFrame:
    s = t.read("supplier").select(key().alias("way_id"), F.lit("f").alias("dir"), F.when(key() % 3 != 0, key() % 80 + 0.5).alias("speed_kph"), F.when(key() % 2 == 0, 100.0).alias("free_flow_kph"), F.lit("heavy").alias("los"))
    return emit.speed_csv(s)


@query("""SELECT 'event: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'changed' ELSE 'removed' END || chr(10) || 'data: {"id":' || o_orderkey || ',"change":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'changed' ELSE 'removed' END || '"}' || chr(10) || chr(10) AS value FROM orders""")
def event_frames(t: Tables) -> DataFrame:
    return emit.sse_frames(t.read("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "changed").otherwise("removed").alias("change")))


@query(f"""WITH {OBS} SELECT id, round((id % 120) / 100.0::DOUBLE, 6) AS ratio FROM obs WHERE status = 'active' AND id % 2 = 0""")
def consumer_flows(t: Tables) -> DataFrame:
    k = F.col("id")
    o = t.obs().withColumns({"kind": F.when(k % 2 == 0, "measurement").otherwise("event"), "speed_kph": (k % 120).cast("double"), "free_flow_kph": F.lit(100.0), "los": F.lit("unknown"), "headline": F.lit("x"), "points": F.array().cast(geometry.POSITIONS)})
    return emit.consumer_rows(o)[1].select("id", F.round("ratio", 6).alias("ratio"))


# --- event feeds -------------------------------------------------------------

DJB2 = "lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296), 36))"
XT, YT = "(4 + s_suppkey % 90) || '.5'", "(10 + s_suppkey % 70) || '.25'"
TXY = "(4 + s_suppkey % 90) + 0.5::DOUBLE AS lon, (10 + s_suppkey % 70) + 0.25::DOUBLE AS lat"


def txy():
    return F.concat((4 + key() % 90).cast("string"), F.lit(".5")), F.concat((10 + key() % 70).cast("string"), F.lit(".25"))


@query("SELECT 'pl:' || " + DJB2.format(f"'A' || s_suppkey || '|12|' || {YT} || '|' || {XT}") + f" AS id, CASE s_suppkey % 5 WHEN 0 THEN 'road_closure' WHEN 1 THEN 'hazard' WHEN 2 THEN 'accident' WHEN 3 THEN 'roadworks' ELSE 'other' END AS type, CASE s_suppkey % 5 WHEN 0 THEN 'incident' WHEN 2 THEN 'incident' WHEN 3 THEN 'planned' ELSE 'conditions' END AS category, 'A' || s_suppkey AS headline, {TXY} FROM supplier WHERE s_suppkey % 7 <> 0")
def events_gddkia(t: Tables) -> DataFrame:
    x, y = txy()
    k = key()
    yes = lambda n: F.when(k % 5 == n, "true").otherwise("false")
    raw = t.read("supplier").select(F.format_string("<utr><typ>%s</typ><nr_drogi>A%d</nr_drogi><km>12</km><geo_lat>%s</geo_lat><geo_long>%s</geo_long><droga_zamknieta>%s</droga_zamknieta><awaria_mostu>%s</awaria_mostu></utr>", F.when(k % 5 == 2, "W").when(k % 5 == 3, "U").otherwise("X"), k, F.when(k % 7 == 0, "?").otherwise(y), x, yes(0), yes(1)).alias("value"))
    return first_point(events.gddkia(datex.cut(raw, "utr"), "pl")).select("id", "type", "category", "headline", "lon", "lat")


@query("SELECT 'sg:' || " + DJB2.format(f"CASE s_suppkey % 3 WHEN 0 THEN 'Roadwork' WHEN 1 THEN 'Heavy Traffic' ELSE 'Misc.' END || '|' || {YT} || '|' || {XT} || '|m' || s_suppkey") + f" AS id, CASE s_suppkey % 3 WHEN 0 THEN 'roadworks' WHEN 1 THEN 'congestion' ELSE 'other' END AS type, s_suppkey % 3 = 0 AS planned, 'm' || s_suppkey AS headline, {TXY} FROM supplier")
def events_lta(t: Tables) -> DataFrame:
    x, y = txy()
    kind = F.element_at(F.array(F.lit("Roadwork"), F.lit("Heavy Traffic"), F.lit("Misc.")), (key() % 3 + 1).cast("int"))
    s = F.format_string('{"Type":"%s","Latitude":%s,"Longitude":%s,"Message":"m%d"}', kind, y, x, key())
    return first_point(events.lta(documents(t.read("supplier"), s, '{"value":[', "]}"), "sg")).select("id", "type", "planned", "headline", "lon", "lat")


@query(f"SELECT 'oh:' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'roadworks' WHEN s_suppkey % 3 = 0 THEN 'accident' ELSE 'other' END AS type, s_suppkey % 2 = 0 AS planned, CASE WHEN s_suppkey % 4 = 1 THEN 'some_lanes_closed' WHEN s_suppkey % 4 = 2 THEN 'closed' END AS road_state, 'R' || s_suppkey AS road, {TXY} FROM supplier")
def events_ohgo(t: Tables) -> DataFrame:
    x, y = txy()
    status = F.element_at(F.array(F.lit("?"), F.lit("Lanes Closed"), F.lit("Closed"), F.lit("")), (key() % 4 + 1).cast("int"))
    start = F.when(key() % 2 == 0, F.lit('"startDate":"2024-01-01",')).otherwise("")
    s = F.concat(F.lit("{"), start, F.format_string('"Id":"%d","Category":"%s","Latitude":%s,"Longitude":%s,"RoadStatus":"%s","RouteName":"R%d"}', key(), F.when(key() % 3 == 0, "Crash").otherwise("Else"), y, x, status, key()))
    return first_point(events.ohgo_events(documents(t.read("supplier"), s, '{"results":[', "]}"), "oh")).select("id", "type", "planned", "road_state", "road", "lon", "lat")


@query(f"SELECT 'se:' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'accident' ELSE 'roadworks' END AS type, CASE s_suppkey % 6 WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 0 THEN 'unknown' ELSE 'low' END AS severity, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS vertices, {TXY} FROM supplier")
def events_trafikverket(t: Tables) -> DataFrame:
    x, y = txy()
    place = F.when(key() % 3 == 0, F.format_string('"Line":{"WGS84":"LINESTRING (%s %s, 20 60)"}', x, y)).otherwise(F.format_string('"Point":{"WGS84":"POINT (%s %s)"}', x, y))
    s = F.format_string('{"Deviation":[{"Id":"%d","MessageType":"%s","SeverityCode":%d,"Message":"m","Geometry":{%s}},{"Id":"none"}]}', key(), F.when(key() % 2 == 0, "Olycka").otherwise("Vägarbete"), key() % 6, place)
    e = events.trafikverket_events(documents(t.read("supplier"), s, '{"RESPONSE":{"RESULT":[{"Situation":[', "]}]}}"), "se")
    return first_point(e.withColumn("vertices", F.size("points"))).select("id", "type", "severity", "vertices", "lon", "lat")


@query(f"SELECT 'ny:' || s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'road_closure' WHEN s_suppkey % 2 = 0 THEN 'accident' ELSE 'roadworks' END AS type, CASE s_suppkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'unknown' END AS severity, CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END::INTEGER AS vertices, CASE WHEN s_suppkey % 4 = 0 THEN -120.2::DOUBLE ELSE (4 + s_suppkey % 90) + 0.5::DOUBLE END AS lon FROM supplier WHERE s_suppkey % 4 < 3")
def events_ibi511(t: Tables) -> DataFrame:
    x, y = txy()
    place = F.when(key() % 4 == 0, F.lit('"EncodedPolyline":"_p~iF~ps|U_ulLnnqC_mqNvxq`@"')).when(key() % 4 == 3, F.lit('"Latitude":null')).otherwise(F.concat(F.format_string('"Latitude":%s,"Longitude":%s', y, x), F.when(key() % 4 == 1, F.lit(',"LatitudeSecondary":1,"LongitudeSecondary":2')).otherwise("")))
    s = F.concat(F.format_string('{"ID":%d,"EventType":"%s","Severity":"%s","IsFullClosure":%s,', key(), F.when(key() % 2 == 0, "accidentsAndIncidents").otherwise("Road Work"), F.when(key() % 3 == 0, "Severe").when(key() % 3 == 1, "Minor").otherwise("?"), F.when(key() % 5 == 0, "true").otherwise("false")), place, F.lit("}"))
    e = events.ibi511(documents(t.read("supplier"), s, "[", "]"), "ny")
    return first_point(e.withColumn("vertices", F.size("points"))).select("id", "type", "severity", "vertices", "lon")


@query(f"SELECT 'vic:' || s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'weather' WHEN 1 THEN 'hazard' ELSE 'other' END AS type, s_suppkey % 2 = 0 AS planned, CASE WHEN s_suppkey % 2 = 0 THEN 'Planned disruption' ELSE 'Road disruption' END AS headline, {TXY} FROM supplier")
def events_vic(t: Tables) -> DataFrame:
    x, y = txy()
    s = t.read("supplier")
    sub = F.when(key() % 3 == 0, "Flooding").when(key() % 3 == 1, "unheard of").otherwise("?")
    kind = F.when(key() % 3 == 1, "Fallen Tree").otherwise("x")
    geo = F.format_string('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[%s,%s]}]}', x, y)
    a = documents(s.where("s_suppkey % 2 = 0"), F.format_string('{"id":%d,"eventSubtype":"%s","eventType":"%s","geometry":%s}', key(), sub, kind, geo), '{"disruptions":[', "]}")
    b = documents(s.where("s_suppkey % 2 = 1"), F.format_string('{"properties":{"id":"%d","eventSubType":"%s","eventType":"%s"},"geometry":{"type":"Point","coordinates":[%s,%s]}}', key(), sub, kind, x, y), '{"features":[', "]}")
    return first_point(events.vic_disruptions(a.union(b), "vic")).select("id", "type", "planned", "headline", "lon", "lat")


@query(f"SELECT 'fi:g' || s_suppkey AS id, 'roadworks' AS type, CASE s_suppkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'unknown' END AS severity, CASE s_suppkey % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'some_lanes_closed' WHEN 2 THEN 'single_lane_alternating' END AS road_state, 40.0::DOUBLE + s_suppkey % 2 AS speed_limit, 'E' || s_suppkey AS road, {TXY} FROM supplier")
def events_digitraffic(t: Tables) -> DataFrame:
    x, y = txy()
    kind = F.element_at(F.array(*[F.lit(v) for v in ("ROAD_CLOSED", "NARROW_LANES", "TRAFFIC_LIGHTS", "OTHER")]), (key() % 4 + 1).cast("int"))
    phase = lambda sev, typ, v: F.concat(F.lit('{"severity":"'), sev, F.lit('","restrictions":[{"type":"'), typ, F.lit('"},{"type":"SPEED_LIMIT","restriction":{"quantity":'), v, F.lit("}}]}"))
    both = F.concat(phase(F.when(key() % 3 < 2, "LOW").otherwise("?"), kind, F.lit("60")), F.lit(","), phase(F.when(key() % 3 == 0, "HIGHEST").otherwise(""), F.when(key() % 4 == 0, "NARROW_LANES").otherwise("X"), (40 + key() % 2).cast("string")))
    s = F.concat(F.format_string('{"geometry":{"type":"Point","coordinates":[%s,%s]},"properties":{"situationId":"g%d","situationType":"ROAD_WORK","announcements":[{"locationDetails":{"roadAddressLocation":{"primaryPoint":{"roadAddress":{"road":"E%d"}}}},"roadWorkPhases":[', x, y, key(), key()), both, F.lit("]}]}}"))
    return first_point(events.digitraffic(documents(t.read("supplier"), s, '{"features":[', "]}"), "fi")).select("id", "type", "severity", "road_state", "speed_limit", "road", "lon", "lat")


@query(f"""WITH {OBS} SELECT id, '<message id="' || id || '" receive_time="' || strftime(valid_from, '%Y-%m-%dT%H:%M:%SZ') || '" update_time="' || strftime(valid_from, '%Y-%m-%dT%H:%M:%SZ') || '" urgency="' || CASE severity WHEN 'critical' THEN 'X_URGENT' WHEN 'high' THEN 'URGENT' ELSE 'NORMAL' END || '" expiration_time="' || strftime(coalesce(expires_at, valid_to), '%Y-%m-%dT%H:%M:%SZ') || '" start_time="' || strftime(valid_from, '%Y-%m-%dT%H:%M:%SZ') || '" end_time="' || strftime(valid_to, '%Y-%m-%dT%H:%M:%SZ') || '"><events>'
  || CASE id % 4 WHEN 0 THEN '<event class="RESTRICTION" type="RESTRICTION_CLOSED"/>' WHEN 1 THEN '<event class="RESTRICTION" type="RESTRICTION_MAX_HEIGHT"/>' WHEN 2 THEN '<event class="CONGESTION" type="CONGESTION_TRAFFIC_CONGESTION"/>' ELSE '<event class="INCIDENT" type="INCIDENT_ACCIDENT"/><event class="RESTRICTION" type="RESTRICTION_LANE_CLOSED"/>' END || '</events><location road_ref="A&amp;1"' || CASE WHEN id % 2 = 0 THEN ' directionality="ONE_DIRECTION"><from>+50.5 -4.25</from><to>+51.0 +5.0</to>' ELSE '><at>+50.5 -4.25</at>' END || '</location></message>' AS value FROM obs""")
def traff_messages(t: Tables) -> DataFrame:
    k = F.col("id")
    p = lambda x, y: F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"))
    o = t.obs().withColumns({"type": F.when(k % 4 == 0, "road_closure").when(k % 4 == 1, "dimension_restriction").when(k % 4 == 2, "other").otherwise("accident"), "dimension": F.when(k % 4 == 1, "height"), "road_state": F.when(k % 4 == 0, "closed").when(k % 4 == 3, "some_lanes_closed"), "road": F.lit("A&1"), "direction": F.lit(None).cast("string"), "points": F.when(k % 2 == 0, F.array(p(-4.25, 50.5), p(5.0, 51.0))).otherwise(F.array(p(-4.25, 50.5))), "updated_at": F.col("valid_from")})
    return emit.traff_messages(o)


# --- roads -------------------------------------------------------------------


@query("SELECT s_suppkey AS way_id, CASE WHEN s_suppkey % 2 = 0 THEN 'motorway' ELSE 'primary' END AS highway, s_suppkey % 3 = 0 AS oneway, 2 AS n FROM supplier WHERE s_suppkey % 5 <> 0")
def ways_from_lines(t: Tables) -> DataFrame:
    k = key()
    s = F.concat(F.lit("\x1e"), F.format_string('{"type":"Feature","id":"w%d","properties":{"highway":"%s","oneway":"%s"},"geometry":{"type":"%s","coordinates":[[4,50],[5,51]]}}', k, F.when(k % 2 == 0, "motorway").otherwise("primary"), F.when(k % 3 == 0, "yes").otherwise("no"), F.when(k % 5 == 0, "MultiPoint").otherwise("LineString")))
    return roads.geojson_ways(t.read("supplier").select(s.alias("value"))).select("way_id", "highway", "oneway", F.size("coords").alias("n"))


@query("""WITH w AS (SELECT s_suppkey AS k, i FROM supplier, (VALUES (0), (1)) v(i)) SELECT k AS way_id, k * 10 + i + b AS start_node, k * 10 + i + 1 - b AS end_node, CASE WHEN k % 2 = 0 THEN 0 ELSE 2 END AS frc, CASE WHEN k % 5 = 0 THEN 4 WHEN k % 2 = 0 THEN 1 WHEN k % 3 = 0 THEN 6 ELSE 3 END AS fow FROM w, (VALUES (0), (1)) d(b) WHERE b = 0 OR k % 4 <> 0""")
def road_graph(t: Tables) -> DataFrame:
    k = key()
    node = lambda i: F.struct((k * 10 + i).alias("node"), F.lit(4.0).alias("lon"), F.lit(50.0).alias("lat"))
    w = t.read("supplier").select(k.alias("way_id"), F.when(k % 2 == 0, "motorway").when(k % 3 == 0, "primary_link").otherwise("primary").alias("highway"), F.when(k % 5 == 0, "roundabout").alias("junction"), (k % 4 == 0).alias("oneway"), F.array(node(0), node(1), node(2)).alias("nodes"))
    return roads.graph(w)[1].select("way_id", "start_node", "end_node", "frc", "fow")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'no-table' WHEN s_suppkey % 7 = 1 THEN 'version-missing' WHEN s_suppkey % 7 = 2 AND s_suppkey % 2 = 0 THEN 'version-mismatch' END AS reason,
  CASE WHEN s_suppkey % 7 IN (0, 1) OR (s_suppkey % 7 = 2 AND s_suppkey % 2 = 0) THEN NULL WHEN s_suppkey % 5 = 0 THEN 1 WHEN s_suppkey % 5 = 4 THEN 2 ELSE 1 + s_suppkey % 5 END::INTEGER AS n, s_suppkey % 7 = 2 AND s_suppkey % 2 = 1 AS via_road FROM supplier""")
def location_codes(t: Tables) -> DataFrame:
    """A list of a hundred codes in a chain; references some steps apart, forward or back, or to a code that no chain reaches."""
    n = t.spark.range(1, 102)
    c = F.col("id").cast("string")
    pts = n.select(c.alias("LCD"), (F.col("id") * 1000).cast("string").alias("XCOORD"), F.lit("5000000").alias("YCOORD"), F.when(F.col("id") % 2 == 0, "7").otherwise("").alias("ROA_LCD"), F.when(F.col("id") % 2 == 1, "8").otherwise("").alias("SEG_LCD"))
    off = n.select(c.alias("LCD"), F.when(F.col("id") < 100, (F.col("id") + 1).cast("string")).otherwise("").alias("POS_OFF_LCD"), F.when((F.col("id") > 1) & (F.col("id") < 101), (F.col("id") - 1).cast("string")).otherwise("").alias("NEG_OFF_LCD"))
    road = t.spark.createDataFrame([("7", "A12")], "LCD string, ROADNUMBER string")
    seg = t.spark.createDataFrame([("8", "", "7")], "LCD string, ROADNUMBER string, ROA_LCD string")
    k = key()
    base = (20 + k % 40).cast("int")
    other = F.when(k % 5 == 0, base).when(k % 5 == 4, F.lit(101)).when(k % 2 == 0, base + (k % 5).cast("int")).otherwise(base - (k % 5).cast("int"))
    refs = t.read("supplier").select(k.alias("id"), F.when(k % 7 == 0, "FR").otherwise("nl").alias("country"), F.lit("9").alias("table_no"), F.when(k % 7 == 1, "").when(k % 7 == 2, "1.0").otherwise("5.10").alias("version"), F.when(k % 2 == 1, "N A-12").otherwise("A99").alias("road"), base.alias("primary"), other.alias("secondary"))
    return roads.resolved_codes(refs, roads.location_table(pts, off, road, seg), "NL", 9.0, "5.1").select("id", "reason", F.size("points").alias("n"), "via_road").withColumn("n", F.when(F.col("reason").isNull(), F.col("n")))


@query("SELECT s_suppkey::VARCHAR AS site, s_suppkey % 3 AS kind, " + TXY + " FROM supplier WHERE s_suppkey % 4 <> 0")
def station_registries(t: Tables) -> DataFrame:
    """GeoJSON, a table of text with decimal commas, XML."""
    x, y = txy()
    s = t.read("supplier")
    bad = key() % 4 == 0
    a = events.registry_geojson(documents(s.where("s_suppkey % 3 = 0"), F.concat(F.format_string('{"id":%d,"geometry":', key()), F.when(bad, F.lit("null")).otherwise(F.format_string('{"type":"Point","coordinates":[%s,%s,0.0]}', x, y)), F.lit("}")), '{"features":[', "]}"))
    b = events.registry_csv(s.where("s_suppkey % 3 = 1").select(key().cast("string").alias("n"), F.when(bad, "").otherwise(F.replace(x, F.lit("."), F.lit(","))).alias("x"), F.replace(y, F.lit("."), F.lit(",")).alias("y")), "n", "x", "y")
    c = events.registry_miv(datex.cut(s.where("s_suppkey % 3 = 2").select(F.format_string('<meetpunt unieke_id="%d"><lengtegraad_EPSG_4326>%s</lengtegraad_EPSG_4326><breedtegraad_EPSG_4326>%s</breedtegraad_EPSG_4326></meetpunt>', key(), F.when(bad, "").otherwise(x), y).alias("value")), "meetpunt"))
    tag = lambda df, n: df.withColumn("kind", F.lit(n).cast("long"))
    return first_point(tag(a, 0).unionByName(tag(b, 1)).unionByName(tag(c, 2))).select("site", "kind", "lon", "lat")


SEGMENT_ENDS = "SELECT s_suppkey AS segment_id, 4.0::DOUBLE + (s_suppkey % 97) * 0.01::DOUBLE AS ax, 50.0::DOUBLE + (s_suppkey % 89) * 0.01::DOUBLE AS ay, CASE WHEN s_suppkey % 6 < 2 THEN 5 WHEN s_suppkey % 6 = 2 THEN 8 WHEN s_suppkey % 6 = 3 THEN 10 WHEN s_suppkey % 6 = 4 THEN 12 ELSE 13 END AS min_zoom FROM supplier"


@query(f"""WITH s AS ({SEGMENT_ENDS}), p AS (SELECT *, (ax + 180) / 360 * 256 - 131 AS u, (1 - ln(tan(radians(ay)) + 1 / cos(radians(ay))) / pi()) / 2 * 256 - 86 AS v FROM s WHERE min_zoom <= 8)
SELECT segment_id, CASE WHEN segment_id % 2 = 0 THEN 50.0::DOUBLE END AS speed_kph, round(u * 4096)::INTEGER AS x, round(v * 4096)::INTEGER AS y FROM p WHERE ax + 0.01 >= 131 / 256.0 * 360 - 180 AND ax <= 132 / 256.0 * 360 - 180 AND ay + 0.01 >= degrees(atan(sinh(pi() * (1 - 2 * 87 / 256.0)))) AND ay <= degrees(atan(sinh(pi() * (1 - 2 * 86 / 256.0))))""")
def segment_tile(t: Tables) -> DataFrame:
    """The segments on tile 8/131/86."""
    k = key()
    ax, ay = F.lit(4.0) + (k % 97) * 0.01, F.lit(50.0) + (k % 89) * 0.01
    zoom = F.when(k % 6 < 2, 5).when(k % 6 == 2, 8).when(k % 6 == 3, 10).when(k % 6 == 4, 12).otherwise(13)
    s = t.read("supplier").select(k.alias("segment_id"), ax.alias("ax"), ay.alias("ay"), (ax + 0.01).alias("bx"), (ay + 0.01).alias("by"), zoom.alias("min_zoom"))
    v = s.where("segment_id % 2 = 0").select("segment_id", F.lit(50.0).alias("speed_kph"))
    return segments.tile(s, v, 8, 131, 86).select("segment_id", "speed_kph", F.col("line")[0].x.alias("x"), F.col("line")[0].y.alias("y"))


@query("SELECT s_suppkey AS way_id FROM supplier WHERE s_suppkey % 3 <> 1")
def region_rebuilt(t: Tables) -> DataFrame:
    w = t.read("supplier").select(key().alias("way_id"), F.concat(F.lit("r"), (key() % 3).cast("string")).alias("region"))
    return segments.without_regions(w.select("way_id"), w, ["r1"])


@query("SELECT s_suppkey AS segment_id, 2 AS points, s_suppkey % 2 = 0 AS motorway FROM supplier WHERE s_suppkey % 4 <> 0")
def segment_references(t: Tables) -> DataFrame:
    """References of segments without one, read back."""
    k = key()
    ax, ay = F.lit(4.0) + (k % 97) * 0.01, F.lit(50.0) + (k % 89) * 0.01
    s = t.read("supplier").select(k.alias("segment_id"), F.when(k % 2 == 0, "motorway").otherwise("primary").alias("highway"), F.lit(None).cast("string").alias("junction"), F.lit(True).alias("oneway"), ax.alias("ax"), ay.alias("ay"), (ax + 0.01).alias("bx"), (ay - 0.01).alias("by"), F.lit(1300.0).alias("length_m"), F.when(k % 4 == 0, "x").alias("openlr"))
    d = segments.line_references(s).withColumn("d", openlr.decoded(F.col("openlr")))
    return d.select("segment_id", F.size("d.points").alias("points"), (F.col("d.points")[0].fow == 1).alias("motorway"))


# --- streams -----------------------------------------------------------------


@query("""WITH w AS (SELECT user_id AS actor, ts, unnest(range(0, 6)) AS k FROM events), g AS (SELECT actor, (floor(epoch(ts) / 600)::BIGINT + 1 + k) * 600 AS until_s FROM w) SELECT actor, until_s, count(*)::BIGINT AS n FROM g GROUP BY 1, 2 HAVING until_s <= (SELECT floor(epoch_us(max(ts)) / 1000000.0 - 300) FROM events)""")
def stream_sliding_counts(t: Tables) -> DataFrame:
    s = jobs.stream_parquet(t.spark, f"{t.sf_dir}/event[s].parquet", t.read("events").schema).select(F.col("user_id").alias("actor"), F.col("ts").cast("timestamp").alias("at"))
    got = jobs.run_to_table(jobs.sliding_counts(s, "60 minutes", "10 minutes"), "sliding")
    return got.select("actor", F.unix_seconds("until").alias("until_s"), "n")
