"""All named queries of the engine and their SQL. Times are written as epoch seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.operators import changes, crowd, privacy, read, resolution, segments, speed
from wayloom.plans import exchange, feeds, places, upkeep  # noqa: F401  (their queries)
from wayloom.plans.adapters import BINS, LIVE, NOW, OBS, OBS_NOW, SAMPLES, SEGMENTS, Tables, haversine
from wayloom.plans.registry import oracle_sql, queries, query  # noqa: F401
from wayloom.streaming import jobs


def now():
    return F.lit(NOW).cast("timestamp")


def obs_now():
    return F.lit(OBS_NOW).cast("timestamp")


def secs(c: str):
    return F.unix_seconds(c)


def text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- speed history -----------------------------------------------------------


@query(f"""WITH {BINS} SELECT sensor_key, epoch(hour)::BIGINT AS hour, min(source) AS source, sum(c)::BIGINT AS sample_count,
  string_agg(bin::VARCHAR, ',' ORDER BY bin) AS speed_bins, string_agg(c::VARCHAR, ',' ORDER BY bin) AS speed_counts FROM bins GROUP BY 1, 2""")
def speed_hourly_histogram(t: Tables) -> DataFrame:
    h = speed.hourly_histogram(t.samples())
    return h.select("sensor_key", secs("hour").alias("hour"), "source", "sample_count", text("speed_bins").alias("speed_bins"), text("speed_counts").alias("speed_counts"))


P85 = """, m AS (SELECT {keys}, bin, sum(c) AS c FROM b GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum, sum(c) OVER (PARTITION BY {keys}) AS total FROM m)
SELECT {keys}, (min(bin) FILTER (WHERE cum >= {f} * total) * 2 + 1)::DOUBLE AS {name}, max(total)::BIGINT AS sample_count FROM r GROUP BY ALL HAVING max(total) >= {least}"""
BASES = f"""WITH {BINS}, b AS (SELECT sensor_key, -1 AS dow_bucket, -1 AS tod_bucket, bin, c FROM bins
  UNION ALL SELECT sensor_key, (extract(dow FROM hour) IN (0, 6))::INTEGER, extract(hour FROM hour)::INTEGER, bin, c FROM bins)""" + P85.format(keys="sensor_key, dow_bucket, tod_bucket", f="0.85", name="free_flow_kph", least="{least}")


@query(BASES.format(least=3))
def baseline_p85_bucketed(t: Tables) -> DataFrame:
    return speed.baselines(speed.bin_counts(t.samples()), 3).drop("method")


@query(f"SELECT sensor_key, free_flow_kph, sample_count FROM ({BASES.format(least=30)}) WHERE dow_bucket = -1")
def baseline_p85_overall(t: Tables) -> DataFrame:
    return speed.histogram_percentile(speed.bin_counts(t.samples()), ["sensor_key"], "0.85", "free_flow_kph", 30)


@query(f"""WITH {BINS}, b AS (SELECT sensor_key, extract(dow FROM l)::INTEGER AS dow, extract(hour FROM l)::INTEGER AS tod_hour, bin, c FROM (
  SELECT *, timezone('Europe/Amsterdam', timezone('UTC', hour)) AS l FROM bins))""" + P85.format(keys="sensor_key, dow, tod_hour", f="0.5", name="median_kph", least=2))
def profile_p50_local_tz(t: Tables) -> DataFrame:
    return speed.weekly_profile(speed.bin_counts(t.samples()), "sensor_key", "Europe/Amsterdam", 2)


@query(f"""WITH {BINS}, m AS (SELECT sensor_key, bin, sum(c) AS c FROM bins GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY sensor_key ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum, sum(c) OVER (PARTITION BY sensor_key) AS total FROM m),
h AS (SELECT sensor_key, (min(bin) FILTER (WHERE cum >= 0.85 * total) * 2 + 1)::DOUBLE AS p FROM r GROUP BY 1),
e AS (SELECT sensor_key, quantile_disc(speed_kph, 0.85) AS x FROM samples GROUP BY 1)
SELECT sensor_key, abs(p - x) <= 2.0 AS within_bin FROM h JOIN e USING (sensor_key)""")
def histogram_vs_exact_error(t: Tables) -> DataFrame:
    h = speed.histogram_percentile(speed.bin_counts(t.samples()), ["sensor_key"], "0.85", "p", 1)
    exact = t.samples().groupBy("sensor_key").agg(F.expr("percentile_disc(0.85) within group (order by speed_kph)").alias("x"))
    return h.join(exact, "sensor_key").select("sensor_key", (F.abs(F.col("p") - F.col("x")) <= 2.0).alias("within_bin"))


@query("""SELECT user_id AS sensor_key, CASE WHEN user_id % 3 = 0 THEN 'native' WHEN user_id % 3 = 1 THEN 'derived' ELSE 'osm_maxspeed' END AS method,
  CASE WHEN user_id % 3 = 0 THEN 100.0 WHEN user_id % 3 = 1 THEN 90.0 ELSE 80.0 END::DOUBLE AS free_flow_kph FROM (SELECT DISTINCT user_id FROM events)""")
def baseline_method_pick(t: Tables) -> DataFrame:
    s = t.events().select(F.col("user_id").alias("sensor_key")).distinct()
    offer = F.array(F.struct(F.lit("osm_maxspeed").alias("method"), F.lit(80.0).alias("free_flow_kph"), F.lit(2).alias("upto")), F.struct(F.lit("derived").alias("method"), F.lit(90.0).alias("free_flow_kph"), F.lit(1).alias("upto")), F.struct(F.lit("native").alias("method"), F.lit(100.0).alias("free_flow_kph"), F.lit(0).alias("upto")))
    rows = s.select("sensor_key", F.inline(offer)).where("sensor_key % 3 <= upto").withColumns({"dow_bucket": F.lit(-1), "tod_bucket": F.lit(-1)})
    return speed.pick_baseline(rows)


@query(f"WITH {SAMPLES} SELECT greatest(floor(epoch(max(observed_at) - INTERVAL 6 HOUR)), epoch(TIMESTAMP '{NOW}' - INTERVAL 35 DAY))::BIGINT AS from_s, epoch(TIMESTAMP '{NOW}')::BIGINT AS to_s FROM samples")
def rollup_range_watermark(t: Tables) -> DataFrame:
    lo, hi = speed.rollup_range(now(), F.max("observed_at"))
    return t.samples().agg(F.unix_seconds(lo).alias("from_s"), F.unix_seconds(hi).alias("to_s"))


@query(f"""WITH {BINS}, done AS (SELECT DISTINCT sensor_key, hour FROM bins WHERE sensor_key % 2 = 0)
SELECT s.sensor_key, floor(epoch(observed_at))::BIGINT AS at_s, speed_kph FROM samples s LEFT JOIN done d ON d.sensor_key = s.sensor_key AND d.hour = date_trunc('hour', observed_at)
WHERE (observed_at < TIMESTAMP '{NOW}' - INTERVAL 10 DAY AND d.hour IS NOT NULL) OR observed_at < TIMESTAMP '{NOW}' - INTERVAL 25 DAY""")
def prune_raw_candidates(t: Tables) -> DataFrame:
    s = t.samples()
    return speed.prunable(s, speed.hourly_histogram(s.where("sensor_key % 2 = 0")), now(), 10, 25).select("sensor_key", secs("observed_at").alias("at_s"), "speed_kph")


@query(f"""WITH {SAMPLES}, b AS (SELECT sensor_key, floor(epoch(observed_at) / 3600)::BIGINT AS bucket, (observed_at, speed_kph, source) AS x FROM samples)
SELECT sensor_key, bucket * 3600 AS at_s, min(x)[2] AS speed_kph FROM b GROUP BY 1, 2""")
def raw_cadence_dedup(t: Tables) -> DataFrame:
    return speed.raw_samples(t.samples(), 3600).select("sensor_key", secs("observed_at").alias("at_s"), "speed_kph")


PROFILE = f"""WITH {BINS}, m AS (SELECT sensor_key, extract(dow FROM hour)::INTEGER AS dow, extract(hour FROM hour)::INTEGER AS tod_hour, bin, sum(c) AS c FROM bins GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY sensor_key, dow, tod_hour ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum, sum(c) OVER (PARTITION BY sensor_key, dow, tod_hour) AS total FROM m),
p AS (SELECT sensor_key, dow, tod_hour, (min(bin) FILTER (WHERE cum >= 0.5 * total) * 2 + 1)::DOUBLE AS v FROM r GROUP BY ALL)"""


@query(PROFILE + """ SELECT sensor_key, string_agg(coalesce(v::BIGINT::VARCHAR, '-'), ',' ORDER BY i) AS week FROM (
  SELECT k.sensor_key, i, v FROM (SELECT DISTINCT sensor_key FROM p) k CROSS JOIN range(168) s(i) LEFT JOIN p ON p.sensor_key = k.sensor_key AND p.dow * 24 + p.tod_hour = i) GROUP BY 1""")
def weekly_168_profile(t: Tables) -> DataFrame:
    w = speed.week_array(speed.weekly_profile(speed.bin_counts(t.samples()), "sensor_key", "UTC", 1), "sensor_key")
    return w.select("sensor_key", F.array_join(F.transform("week", lambda x: F.coalesce(x.cast("long").cast("string"), F.lit("-"))), ",").alias("week"))


@query(PROFILE + " SELECT sensor_key, median(v) AS daytime_kph FROM p WHERE tod_hour BETWEEN 7 AND 19 GROUP BY 1")
def daytime_median(t: Tables) -> DataFrame:
    return speed.daytime_median(speed.weekly_profile(speed.bin_counts(t.samples()), "sensor_key", "UTC", 1), "sensor_key")


# --- live views --------------------------------------------------------------

BBOX = (4.2, 50.2, 5.0, 51.0)
IN_BOX = "lon BETWEEN 4.2::DOUBLE AND 5.0::DOUBLE AND lat BETWEEN 50.2::DOUBLE AND 51.0::DOUBLE"


@query(f"WITH {OBS} SELECT id, severity FROM obs WHERE {IN_BOX} AND {LIVE} ORDER BY rank DESC, id LIMIT 200")
def bbox_live_topk(t: Tables) -> DataFrame:
    return read.read_live(t.obs(), BBOX, obs_now(), limit=200).select("id", "severity")


@query(f"WITH {OBS} SELECT id FROM obs WHERE valid_from IS NULL OR valid_from <= now + INTERVAL 30 DAY")
def horizon_filter(t: Tables) -> DataFrame:
    return t.obs().where(read.within_horizon(obs_now(), 30)).select("id")


@query(f"WITH {OBS} SELECT id, severity FROM obs WHERE rank >= 3")
def min_severity(t: Tables) -> DataFrame:
    return t.obs().where(read.min_severity("high")).select("id", "severity")


@query(f"WITH {OBS} SELECT id FROM obs WHERE NOT (origin_kind = 'crowd' AND NOT routing_eligible)")
def routing_eligible(t: Tables) -> DataFrame:
    return t.obs().where(read.routing_eligible()).select("id")


STATUS = "status AS (SELECT source, max(valid_from) AS last_success FROM obs WHERE source NOT LIKE '5%' GROUP BY 1)"


@query(f"""WITH {OBS}, {STATUS} SELECT id, s.last_success IS NULL OR s.last_success + INTERVAL 1 SECOND * (86400 * 400) < TIMESTAMP '2000-01-01' AS is_stale FROM obs LEFT JOIN status s USING (source)""")
def read_staleness(t: Tables) -> DataFrame:
    o = t.obs()
    status = o.where("source not like '5%'").groupBy("source").agg(F.max("valid_from").alias("last_success")).withColumn("window_s", F.lit(86400 * 400))
    return read.with_staleness(o, status, F.lit("2000-01-01 00:00:00").cast("timestamp")).select("id", "is_stale")


@query(f"""WITH {OBS}, x AS (SELECT *, CASE id % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'single_lane_alternating' END AS state, (id % 3)::INTEGER AS aff, 3 AS tot,
  CASE type WHEN 'O' THEN 'roadworks' WHEN 'F' THEN 'obstruction' ELSE 'other' END AS k, (id % 2400)::INTEGER AS delay FROM obs),
y AS (SELECT *, CASE WHEN severity <> 'unknown' THEN severity WHEN state = 'closed' THEN 'high' WHEN aff > 0 THEN CASE WHEN aff >= tot THEN 'high' WHEN aff * 3 >= tot THEN 'medium' ELSE 'low' END
  WHEN state = 'single_lane_alternating' THEN 'medium' WHEN k = 'roadworks' THEN 'low' WHEN k = 'obstruction' THEN 'medium' ELSE 'unknown' END AS s FROM x)
SELECT id, CASE WHEN delay >= 1200 AND s NOT IN ('high', 'critical') THEN 'high' ELSE s END AS severity FROM y""")
def severity_enrich(t: Tables) -> DataFrame:
    state = F.when(F.col("id") % 4 == 0, "closed").when(F.col("id") % 4 == 1, "single_lane_alternating")
    kind = F.when(F.col("type") == "O", "roadworks").when(F.col("type") == "F", "obstruction").otherwise("other")
    return t.obs().select("id", read.enriched_severity(F.col("severity"), state, F.col("id") % 3, F.lit(3), kind, F.col("id") % 2400).alias("severity"))


@query("""SELECT event_id, CASE WHEN r >= 0.85 THEN 'free_flow' WHEN r >= 0.5 THEN 'heavy' WHEN r >= 0.15 THEN 'queuing' ELSE 'stationary' END AS los FROM (SELECT event_id, value / 200.0 AS r FROM events)""")
def los_classify(t: Tables) -> DataFrame:
    return t.events().select("event_id", S.level_of_service(F.col("value") / 200.0).alias("los"))


@query(f"""WITH {OBS} SELECT id, epoch(valid_from)::BIGINT + CASE WHEN origin_kind = 'crowd' THEN CASE type WHEN 'O' THEN 604800 WHEN 'F' THEN 1800 ELSE 900 END
  ELSE CASE type WHEN 'O' THEN 1209600 WHEN 'F' THEN 3600 ELSE 1800 END END AS expires_s FROM obs""")
def decay_expiry(t: Tables) -> DataFrame:
    kind = F.when(F.col("type") == "O", "roadworks").when(F.col("type") == "F", "accident").otherwise("other")
    return t.obs().select("id", (secs("valid_from") + read.decay_seconds(kind, F.col("origin_kind"))).alias("expires_s"))


@query(f"WITH {OBS} SELECT id FROM obs WHERE {LIVE} AND CASE WHEN privacy_class IS NULL THEN origin_kind = 'feed' ELSE privacy_class = 'authoritative' END")
def archive_rows(t: Tables) -> DataFrame:
    return read.archive_rows(t.obs(), obs_now()).select("id")


@query("SELECT event_id, los, record FROM (SELECT event_id, CASE WHEN value / 200.0 >= 0.85 THEN 'free_flow' WHEN value / 200.0 >= 0.5 THEN 'heavy' WHEN value / 200.0 >= 0.15 THEN 'queuing' ELSE 'stationary' END AS los FROM events), (VALUES ('flow'), ('congestion')) v(record) WHERE record = 'flow' OR los IN ('queuing', 'stationary')")
def congestion_events(t: Tables) -> DataFrame:
    return read.with_congestion_events(t.events().select("event_id", S.level_of_service(F.col("value") / 200.0).alias("los")))


# --- change ------------------------------------------------------------------

PREV = "prev AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 11 <> 0), cur AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 13 <> 0)"
DIFF = PREV + ", d AS (SELECT coalesce(p.id, c.id) AS id, CASE WHEN p.id IS NULL THEN 'inserted' WHEN c.id IS NULL THEN 'deleted' WHEN p.price IS NOT DISTINCT FROM c.price AND p.status IS NOT DISTINCT FROM c.status THEN 'unchanged' ELSE 'updated' END AS change, c.price AS new_price, c.status AS new_status FROM prev p FULL JOIN cur c ON p.id = c.id)"


def _diff(t: Tables) -> DataFrame:
    o = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    prev = o.where("id % 11 <> 0").withColumn("price", F.when(F.col("id") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return changes.diff(prev, o.where("id % 13 <> 0"), "id", ["price", "status"])


@query(f"WITH {DIFF} SELECT change, count(*)::BIGINT AS n FROM d GROUP BY 1")
def swap_diff_counts(t: Tables) -> DataFrame:
    return _diff(t).groupBy("change").agg(F.count("*").alias("n"))


@query(f"WITH {DIFF} SELECT id, change, new_price FROM d WHERE change <> 'unchanged'")
def swap_diff_rows(t: Tables) -> DataFrame:
    return _diff(t).where("change <> 'unchanged'").select("id", "change", "new_price")


@query(f"WITH {DIFF} SELECT id, CASE WHEN change = 'deleted' OR (change = 'updated' AND new_status = 'F') THEN 'delete' WHEN change = 'inserted' THEN 'create' ELSE 'update' END AS operation FROM d WHERE change <> 'unchanged'")
def outbox_capture(t: Tables) -> DataFrame:
    return changes.outbox(_diff(t), True, F.coalesce(F.col("new_status") == "F", F.lit(False))).select("id", "operation")


@query(f"WITH {PREV} SELECT id, price FROM cur")
def diff_applied(t: Tables) -> DataFrame:
    return changes.apply_diff(None, _diff(t), "id", ["price", "status"]).select("id", "price")


@query("SELECT o_custkey AS id, min(o_orderkey) AS ord, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def keyed_last_wins(t: Tables) -> DataFrame:
    return changes.last_wins(t.read("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("price")), "id", "ord")


@query(f"""WITH {OBS}, {STATUS} SELECT id FROM obs o WHERE expires_at <= now OR valid_to <= now OR (origin_kind = 'feed' AND NOT EXISTS (SELECT 1 FROM status s WHERE s.source = o.source AND s.last_success >= now - INTERVAL 48 HOUR))""")
def sweep_stale(t: Tables) -> DataFrame:
    o = t.obs()
    status = o.where("source not like '5%'").groupBy("source").agg(F.max("valid_from").alias("last_success"))
    return changes.sweepable(o, status, obs_now(), 48).select("id")


@query("""WITH p AS (SELECT event_type AS source, ts AS tm, event_type <> 'error' AND event_id % 3 <> 0 AS ok, CASE WHEN event_id % 2 = 0 THEN event_id END AS row_count FROM events)
SELECT source, floor(epoch(max(tm)))::BIGINT AS last_attempt, floor(epoch(max(tm) FILTER (WHERE ok)))::BIGINT AS last_success, arg_max(row_count, tm) FILTER (WHERE row_count IS NOT NULL) AS row_count FROM p GROUP BY 1""")
def source_status_merge(t: Tables) -> DataFrame:
    p = t.events().select(F.col("event_type").alias("source"), F.col("ts").alias("at"), ((F.col("event_type") != "error") & (F.col("event_id") % 3 != 0)).alias("ok"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("row_count"), "event_id")
    return changes.merge_status(p.where("event_id < 5000"), p.where("event_id >= 5000")).select("source", secs("last_attempt").alias("last_attempt"), secs("last_success").alias("last_success"), "row_count")


@query("SELECT event_id, value FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 1) ORDER BY ts DESC, event_id DESC LIMIT 100")
def outbox_page(t: Tables) -> DataFrame:
    return read.page_after(t.events().withColumn("us", F.unix_micros("ts")), ["us", "event_id"], (1705708800000000, 1), 100, 500).select("event_id", "value")


@query(f"SELECT event_id, TRUE AS beyond_window FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def backfill_beyond_window(t: Tables) -> DataFrame:
    j = t.events().withColumnRenamed("ts", "created_at")
    return changes.beyond_window(j, F.lit("2024-01-02 00:00:00").cast("timestamp"), now(), 7).select("event_id", "beyond_window")


# --- segments ----------------------------------------------------------------


@query(f"""WITH {SEGMENTS} SELECT sid::VARCHAR || ':' || dir AS segment_id, highway, CASE WHEN highway IN ('motorway', 'trunk') THEN 5 WHEN highway = 'primary' THEN 8 WHEN highway = 'secondary' THEN 10 WHEN highway = 'tertiary' THEN 12 ELSE 13 END AS min_zoom,
  round({haversine("ax", "ay", "qx", "qy")}, 3) AS length_m, CASE WHEN dir = 'b' THEN qx ELSE ax END AS start_lon FROM segments, (VALUES ('f'), ('b')) v(dir) WHERE dir = 'f' OR highway <> 'motorway'""")
def segment_build_directed(t: Tables) -> DataFrame:
    pt = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ways = t.segments().select(F.col("sid").alias("way_id"), "highway", "ref", (F.col("highway") == "motorway").alias("oneway"), F.array(pt("ax", "ay"), pt("bx", "by")).alias("coords"))
    return segments.directed(ways).select("segment_id", "highway", "min_zoom", F.round("length_m", 3).alias("length_m"), F.col("coords")[0]["lon"].alias("start_lon"))


SENSORS = "sensors AS (SELECT c_custkey AS sensor_key, 4.0::DOUBLE + (c_custkey % 97) * 0.01::DOUBLE + (c_custkey % 11) * 0.0004::DOUBLE AS lon, 50.0::DOUBLE + (c_custkey % 89) * 0.01::DOUBLE + (c_custkey % 3) * 0.0001::DOUBLE AS lat FROM customer)"


@query(f"""WITH {SEGMENTS}, {SENSORS}, a AS (SELECT *, (qx - ax) * (qx - ax) + (qy - ay) * (qy - ay) AS size FROM sensors, segments
  WHERE least(ax, qx) <= lon + 0.003::DOUBLE AND greatest(ax, qx) >= lon - 0.003::DOUBLE AND least(ay, qy) <= lat + 0.003::DOUBLE AND greatest(ay, qy) >= lat - 0.003::DOUBLE),
b AS (SELECT *, CASE WHEN size > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((lon - ax) * (qx - ax) + (lat - ay) * (qy - ay)) / size)) ELSE 0.0::DOUBLE END AS t FROM a),
c AS (SELECT *, ax + t * (qx - ax) AS px, ay + t * (qy - ay) AS py FROM b),
d AS (SELECT *, sqrt(pow(px - lon, 2) + pow(py - lat, 2)) AS planar, {haversine("lon", "lat", "px", "py")} AS m FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY sensor_key ORDER BY planar, sid) AS r FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY sensor_key ORDER BY m, sid) AS n FROM e WHERE r <= 6 AND m <= 35)
SELECT sensor_key, sid, round(t, 6) AS fraction, round(m, 3) AS offset_m FROM f WHERE n = 1""")
def sensor_match_knn(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    s = t.read("customer").select(k.alias("sensor_key"), (F.lit(4.0) + (k % 97) * 0.01 + (k % 11) * 0.0004).alias("lon"), (F.lit(50.0) + (k % 89) * 0.01 + (k % 3) * 0.0001).alias("lat"))
    m = segments.match_sensors(s, t.segments())
    return m.select("sensor_key", "sid", F.round("fraction", 6).alias("fraction"), F.round("offset_m", 3).alias("offset_m"))


FLOW_ROWS = f"""{SAMPLES}, flows AS (SELECT sensor_key, source, observed_at, CASE WHEN sensor_key % 4 > 0 THEN speed_kph END AS v, CASE WHEN sensor_key % 4 = 0 THEN ['free_flow', 'queuing', 'blocked', 'unknown', NULL][sensor_key // 4 % 5 + 1] WHEN sensor_key % 5 = 0 THEN 'stationary' END AS declared,
  CASE WHEN sensor_key % 3 = 0 THEN 90.0::DOUBLE END AS own, (sensor_key % 20)::VARCHAR AS segment_id FROM samples),
usable AS (SELECT *, coalesce(own, CASE WHEN segment_id::INTEGER % 6 > 0 THEN 120.0::DOUBLE END) AS ff FROM flows WHERE v IS NOT NULL OR coalesce(declared, 'unknown') <> 'unknown'),
g AS (SELECT segment_id, source, avg(v) AS v, avg(ff) AS ff, count(*)::BIGINT AS n, max(observed_at) AS tm,
  max(CASE WHEN v IS NULL THEN list_position(['free_flow', 'heavy', 'queuing', 'stationary', 'blocked'], declared) ELSE 0 END) AS r FROM usable GROUP BY 1, 2),
obs AS (SELECT *, CASE WHEN ff > 0 THEN v / ff END AS ratio FROM g),
observed AS (SELECT *, CASE WHEN r > 0 THEN ['free_flow', 'heavy', 'queuing', 'stationary', 'blocked'][r] WHEN ratio IS NULL THEN 'unknown' WHEN ratio >= 0.85 THEN 'free_flow' WHEN ratio >= 0.5 THEN 'heavy' WHEN ratio >= 0.15 THEN 'queuing' ELSE 'stationary' END AS los, tm + INTERVAL 15 MINUTE AS ends FROM obs)"""


def _flows(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("sensor_key")
    level = F.element_at(F.array(*[F.lit(x) for x in ("free_flow", "queuing", "blocked", "unknown")], F.lit(None)), (F.floor(k / 4) % 5 + 1).cast("int"))
    s = t.samples().withColumns({"declared": F.when(k % 4 == 0, level).when(k % 5 == 0, "stationary"), "own_free_flow": F.when(k % 3 == 0, 90.0), "speed_kph": F.when(k % 4 > 0, F.col("speed_kph"))})
    b = s.select("sensor_key", (k % 20).cast("string").alias("segment_id")).distinct()
    seg = F.col("segment_id").cast("int")
    return s, b, b.select("segment_id").distinct().withColumn("free_flow_kph", F.when(seg % 6 > 0, 120.0))


@query(f"WITH {FLOW_ROWS} SELECT segment_id, source, round(v, 6) AS speed_kph, round(ff, 6) AS free_flow_kph, n, floor(epoch(tm))::BIGINT AS at_s, floor(epoch(ends))::BIGINT AS ends_s, los FROM observed")
def segment_observation(t: Tables) -> DataFrame:
    o = segments.segment_observations(*_flows(t))
    return o.select("segment_id", "source", F.round("speed_kph", 6).alias("speed_kph"), F.round("free_flow_kph", 6).alias("free_flow_kph"), "n", secs("observed_at").alias("at_s"), secs("expires_at").alias("ends_s"), "los")


FUSE_AT = "2024-01-30 12:00:00"


@query(f"""WITH {FLOW_ROWS}, sides AS (SELECT segment_id, source, v, ff, ratio, los, tm, ends, CASE source WHEN 'click' THEN 0 WHEN 'view' THEN 2 WHEN 'error' THEN 9 ELSE 1 END AS tier FROM observed
  UNION ALL SELECT segment_id, 'signal', NULL, NULL, NULL, CASE WHEN segment_id::INTEGER % 3 = 0 THEN 'heavy' ELSE 'blocked' END, tm, ends, 0 FROM observed WHERE source = 'view' AND segment_id::INTEGER % 2 = 0),
live AS (SELECT * FROM sides WHERE ends > TIMESTAMP '{FUSE_AT}'),
s AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY tier, tm DESC, source) AS k FROM live WHERE v IS NOT NULL),
d AS (SELECT segment_id, max(list_position(['free_flow', 'heavy', 'queuing', 'stationary', 'blocked'], los)) FILTER (WHERE v IS NULL AND los <> 'unknown') AS r, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM live GROUP BY 1)
SELECT d.segment_id, round(v, 6) AS speed_kph, s.source, round(ratio, 6) AS ratio, coalesce(['free_flow', 'heavy', 'queuing', 'stationary', 'blocked'][r], los) AS los, sources FROM d LEFT JOIN s ON s.segment_id = d.segment_id AND k = 1 WHERE r IS NOT NULL OR v IS NOT NULL""")
def segment_fuse(t: Tables) -> DataFrame:
    o = segments.segment_observations(*_flows(t))
    tier = F.when(F.col("source") == "click", "authoritative").when(F.col("source") == "view", "peer").when(F.col("source") == "error", "other").otherwise("sensor")
    o = o.withColumn("tier", tier).select("segment_id", "source", "speed_kph", "free_flow_kph", "ratio", "los", "observed_at", "expires_at", "tier")
    seg = F.col("segment_id").cast("int")
    signal = o.where((F.col("source") == "view") & (seg % 2 == 0)).withColumns({"source": F.lit("signal"), "tier": F.lit("authoritative"), "speed_kph": F.lit(None).cast("double"), "free_flow_kph": F.lit(None).cast("double"), "ratio": F.lit(None).cast("double"), "los": F.when(seg % 3 == 0, "heavy").otherwise("blocked")})
    f = segments.fuse(o.unionByName(signal), F.lit(FUSE_AT).cast("timestamp"))
    return f.select("segment_id", F.round("speed_kph", 6).alias("speed_kph"), "source", F.round("ratio", 6).alias("ratio"), "los", text("sources").alias("sources"))


# A road of four segments each ten suppliers: ends touch starts, so speeds go on and back; every fifth runs the other way.
ROAD = """e AS (SELECT s_suppkey AS sid, s_suppkey // 4 AS g, s_suppkey % 4 AS i, 4.0::DOUBLE + (s_suppkey // 4 % 50) * 0.1::DOUBLE + (s_suppkey % 4) * 0.01::DOUBLE AS x, 50.0::DOUBLE + (s_suppkey // 200) * 0.05::DOUBLE AS y, s_suppkey % 5 = 0 AS back FROM supplier),
l AS (SELECT sid, i, g % 3 AS ref, y, CASE WHEN back THEN x + 0.01::DOUBLE ELSE x END AS ax, CASE WHEN back THEN x ELSE x + 0.01::DOUBLE END AS bx, CASE WHEN back THEN 270 ELSE 90 END AS deg FROM e)"""


@query(f"""WITH {ROAD}, j AS (SELECT d.sid, m.sid AS from_id, (40 + m.sid % 50)::DOUBLE AS v, round(greatest(0, greatest(least(d.ax, d.bx) - greatest(m.ax, m.bx), least(m.ax, m.bx) - greatest(d.ax, d.bx))) * 111320.0::DOUBLE * cos(radians(d.y)), 0) AS near
  FROM l d JOIN l m ON d.ref = m.ref AND d.y = m.y AND d.deg = m.deg AND m.i = 1 AND d.i <> 1 AND ({haversine('m.bx', 'm.y', 'd.ax', 'd.y')} <= 50 OR {haversine('d.bx', 'd.y', 'm.ax', 'm.y')} <= 50))
SELECT sid AS segment_id, from_id, v AS speed_kph, round(v / 100, 6) AS ratio, CASE WHEN v / 100 >= 0.85 THEN 'free_flow' WHEN v / 100 >= 0.5 THEN 'heavy' ELSE 'queuing' END AS los FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY near, from_id) AS r FROM j) WHERE r = 1""")
def segment_propagate(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    g = F.floor(k / 4)
    x, y = F.lit(4.0) + (g % 50) * 0.1 + (k % 4) * 0.01, F.lit(50.0) + F.floor(k / 200) * 0.05
    back = k % 5 == 0
    e = t.read("supplier").select(k.alias("segment_id"), F.when(back, x + 0.01).otherwise(x).alias("ax"), y.alias("ay"), F.when(back, x).otherwise(x + 0.01).alias("bx"), y.alias("by"), F.lit("road").alias("highway"), (g % 3).cast("string").alias("ref"), F.lit(700.0).alias("length_m"), F.lit(100.0).alias("free_flow_kph"))
    v = e.where("segment_id % 4 = 1").select("segment_id", (F.lit(40) + F.col("segment_id") % 50).cast("double").alias("speed_kph"))
    return segments.propagate(e, v).select("segment_id", "from_id", "speed_kph", F.round("ratio", 6).alias("ratio"), "los")


# --- resolution --------------------------------------------------------------

PLACES = "places AS (SELECT c_custkey AS idx, 4.0::DOUBLE + (c_custkey % 31) * 0.0011::DOUBLE AS lon, 50.0::DOUBLE + (c_custkey % 29) * 0.0007::DOUBLE AS lat, c_mktsegment AS type, 's' || (c_custkey % 3) AS source FROM customer)"


def _places(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.read("customer").select(k.alias("idx"), (F.lit(4.0) + (k % 31) * 0.0011).alias("lon"), (F.lit(50.0) + (k % 29) * 0.0007).alias("lat"), F.col("c_mktsegment").alias("type"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"))


@query(f"WITH {PLACES} SELECT a.idx AS i, b.idx AS j, round({haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS metres FROM places a JOIN places b ON a.type = b.type AND a.idx < b.idx WHERE {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 60 AND a.source <> b.source")
def dedupe_edges(t: Tables) -> DataFrame:
    p = _places(t).withColumn("road", F.lit(None).cast("string"))
    return resolution.cross_source_edges(p, 60.0, 60.0).select("i", "j", F.round("metres", 3).alias("metres"))


# Streets run north, so that pairs of one road lie one above the other.
ROADS = f"{PLACES}, roads AS (SELECT *, CASE WHEN idx % 5 > 0 THEN 'A' || (idx % 31) END AS road FROM places)"


@query(f"""WITH {ROADS}, j AS (SELECT a.idx AS i, b.idx AS j, {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS m, a.road AS r, b.road AS s FROM roads a JOIN roads b ON a.type = b.type AND a.idx < b.idx WHERE a.source <> b.source)
SELECT i, j, round(m, 3) AS metres FROM j WHERE coalesce(r = s, TRUE) AND (m <= 75 OR (m <= 250 AND r = s))""")
def dedupe_edges_roads(t: Tables) -> DataFrame:
    k = F.col("idx")
    p = _places(t).withColumn("road", F.when(k % 5 > 0, F.concat(F.lit("A"), (k % 31).cast("string"))))
    return resolution.cross_source_edges(p, strict=True).select("i", "j", F.round("metres", 3).alias("metres"))


@query()
def dedupe_clusters(t: Tables) -> DataFrame:
    p = _places(t).withColumn("label", F.lit(None).cast("string"))
    return resolution.same_source_clusters(p, 120.0)


@query("SELECT s_suppkey, sha256('[\"' || lower(trim(s_name)) || '\",\"' || s_suppkey || '\"]') AS canonical FROM supplier")
def canonical_id(t: Tables) -> DataFrame:
    return t.read("supplier").select("s_suppkey", resolution.canonical_id(F.col("s_name"), F.col("s_suppkey")).alias("canonical"))


@query("SELECT event_id, sha256('[\"' || floor((4.0::DOUBLE + (user_id % 97) * 0.01::DOUBLE) / 0.0009::DOUBLE)::BIGINT || '\",\"' || floor((50.0::DOUBLE + (user_id % 89) * 0.01::DOUBLE) / 0.0009::DOUBLE)::BIGINT || '\",\"roads\",\"' || event_type || '\",\"' || floor(floor(epoch(ts)) / 300)::BIGINT || '\"]') AS fingerprint FROM events")
def phenomenon_fingerprint(t: Tables) -> DataFrame:
    u = F.col("user_id")
    return t.events().select("event_id", resolution.fingerprint(F.lit(4.0) + (u % 97) * 0.01, F.lit(50.0) + (u % 89) * 0.01, F.lit("roads"), F.col("event_type"), F.col("ts")).alias("fingerprint"))


@query("""SELECT event_id, (2 * 3 + 1) * 7 * (2 * greatest(1, ceil(250 / (100 * cos(radians(lat)))))::BIGINT + 1) AS keys, sha256('["' || (floor((4.0::DOUBLE + (user_id % 97) * 0.01::DOUBLE) / 0.0009::DOUBLE)::BIGINT + greatest(1, ceil(250 / (100 * cos(radians(lat)))))::BIGINT) || '","' || (floor(lat / 0.0009::DOUBLE)::BIGINT - 3) || '","roads","' || event_type || '","' || (floor(floor(epoch(ts)) / 300)::BIGINT + 3) || '"]') AS corner, TRUE AS has_corner
FROM (SELECT *, (user_id % 70)::DOUBLE AS lat FROM events)""")
def fingerprint_neighbourhood(t: Tables) -> DataFrame:
    """Of each event the number of keys around, and one of their corners."""
    u = F.col("user_id")
    e = t.events().select("event_id", "ts", (F.lit(4.0) + (u % 97) * 0.01).alias("lon"), (u % 70).cast("double").alias("lat"), F.lit("roads").alias("domain"), F.col("event_type").alias("type"))
    wide = F.greatest(F.lit(1), F.ceil(250 / (100 * F.cos(F.radians("lat")))))
    corner = S.json_hash((S.cell(F.col("lon"), 0.0009) + wide).cast("long"), (S.cell(F.col("lat"), 0.0009) - 3).cast("long"), F.col("domain"), F.col("type"), (S.time_bucket(F.col("ts")) + 3).cast("long"))
    count = resolution.over_neighbourhood(lambda keys, c: len(around := set(keys)) * (1 if c in around else -1), "long", corner)
    n = e.repartition(resolution.dealt_partitions(t.spark)).select("event_id", corner.alias("corner"), count.alias("n"))
    return n.select("event_id", "corner", F.abs("n").alias("keys"), (F.col("n") > 0).alias("has_corner"))


def _candidates(t: Tables) -> DataFrame:
    return _places(t).withColumns({"ts": F.timestamp_seconds(F.lit(1704067200) + (F.col("idx") * 37) % 3000), "actor": F.col("idx") % 7, "direction": F.col("idx") % 2})


@query(f"""WITH {PLACES}, p AS (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ((idx * 37) % 3000) AS ts, idx % 7 AS actor, idx % 2 AS direction FROM places)
SELECT a.idx AS i, b.idx AS j, concat_ws(',', CASE WHEN abs(epoch(a.ts) - epoch(b.ts)) > 900 THEN 'time' END, CASE WHEN a.direction <> b.direction THEN 'direction' END, CASE WHEN a.actor = b.actor THEN 'actor' END) AS reasons
FROM p a JOIN p b ON a.type = b.type AND a.idx < b.idx AND {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 100""")
def match_candidates(t: Tables) -> DataFrame:
    return resolution.matches(_candidates(t), 100.0).select("i", "j", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {PLACES}, p AS (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ((idx * 37) % 3000) AS ts, idx % 7 AS actor, idx % 2 AS direction FROM places)
SELECT a.idx AS i, b.idx AS j, concat_ws(',', CASE WHEN abs(epoch(a.ts) - epoch(b.ts)) > 900 THEN 'time' END, CASE WHEN a.direction <> b.direction THEN 'direction' END, CASE WHEN a.actor = b.actor THEN 'actor' END) AS reasons
FROM p a JOIN p b ON a.type = b.type AND a.idx < b.idx AND {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 250""")
def match_candidates_250m(t: Tables) -> DataFrame:
    return resolution.matches(_candidates(t)).select("i", "j", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 16 <> 0 THEN c_custkey - 1 END AS up FROM customer),
w AS (SELECT id, up AS x FROM l WHERE up IS NOT NULL AND up > 0 UNION ALL SELECT w.id, l.up FROM w JOIN l ON l.id = w.x WHERE l.up IS NOT NULL AND l.up > 0)
SELECT id, min(x) AS survivor FROM w GROUP BY 1""")
def survivor_chain(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return resolution.survivor_chain(t.read("customer").select(k.alias("id"), F.when((k % 16 != 0) & (k > 1), k - 1).alias("merged_into")))


# --- crowd -------------------------------------------------------------------

@query()
def reliability_lower_bound(t: Tables) -> DataFrame:
    g = t.events().groupBy("user_id").agg((F.count_if(F.col("event_type") == "view") + 1).alias("alpha"), (F.count_if(F.col("event_type") == "error") + 1).alias("beta"))
    return g.select("user_id", F.round(crowd.lower_bound(F.col("alpha").cast("double"), F.col("beta").cast("double")), 6).alias("lower_bound"))


@query("""WITH d AS (SELECT DISTINCT user_id AS a, event_type || '/' || strftime(ts, '%Y-%m-%d %H') AS x FROM events) SELECT l.a AS first, r.a AS second, count(*)::BIGINT AS shared FROM d l JOIN d r ON l.x = r.x AND l.a < r.a GROUP BY 1, 2 HAVING count(*) >= 2""")
def coreporting_pairs(t: Tables) -> DataFrame:
    r = t.events().select(F.col("user_id").alias("actor"), F.concat_ws("/", "event_type", F.date_format("ts", "yyyy-MM-dd HH")).alias("thing"))
    return crowd.coreporting(r, 2)


@query("SELECT event_id, (count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) - 1)::BIGINT AS recent FROM events")
def report_rate_window(t: Tables) -> DataFrame:
    return crowd.trailing_rate(t.events().select("event_id", F.col("user_id").alias("actor"), F.col("ts").alias("at")), 86400).select("event_id", "recent")


@query(f"""WITH f AS (SELECT event_id, user_id, ts, value / 50.0 AS lon, 50 + value / 500.0 AS lat FROM events),
p AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(h > 0 AND {haversine('plon', 'plat', 'lon', 'lat')} / 1000 / h > 400, FALSE) AS flagged FROM p""")
def teleport_flags(t: Tables) -> DataFrame:
    f = t.events().select(F.col("event_id").alias("id"), F.col("user_id").alias("actor"), F.col("ts").alias("at"), (F.col("value") / 50.0).alias("lon"), (50 + F.col("value") / 500.0).alias("lat"))
    return crowd.teleports(f).select(F.col("id").alias("event_id"), "flagged")


@query("""WITH f AS (SELECT event_id % 300 AS obs, count(*)::BIGINT AS flags, max(epoch_us(ts)) AS us, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS reasons FROM events WHERE event_type IN ('error', 'click') GROUP BY 1),
r AS (SELECT event_id % 300 AS obs, arg_min(user_id, (ts, event_id)) AS first_actor FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT f.obs, flags, reasons, first_actor FROM f LEFT JOIN r USING (obs) ORDER BY us DESC, f.obs DESC LIMIT 50""")
def flag_queue_page(t: Tables) -> DataFrame:
    e = t.events().withColumn("obs", F.col("event_id") % 300)
    flags = e.where("event_type in ('error', 'click')").select("obs", F.unix_micros("ts").alias("at"), F.col("event_type").alias("reason"))
    reports = e.where("event_type = 'signup'").select("obs", F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("user_id").alias("actor"))
    return read.page_after(crowd.flag_queue(flags, reports), ["flagged_at", "obs"], None, 50, 200).select("obs", "flags", text("reasons").alias("reasons"), "first_actor")


WINDOWS = """p AS (SELECT user_id % 10 AS peer, floor(floor(epoch(ts)) / 3600)::BIGINT AS hour, event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL),
w AS (SELECT peer, hour, sum(n) / 60 AS rate, CASE WHEN count(*) > 1 THEN log2(sum(n)) - sum(n * log2(n)) / sum(n) ELSE 0 END AS entropy, sum(s) / sum(n) AS confidence FROM p GROUP BY 1, 2)"""


def _windows(t: Tables) -> DataFrame:
    return crowd.peer_windows(t.events().select((F.col("user_id") % 10).alias("peer"), F.col("ts").alias("at"), F.col("event_type").alias("type"), F.col("value").alias("confidence")))


@query(f"WITH {WINDOWS} SELECT peer, hour, round(rate, 6) AS rate, round(abs(entropy), 6) AS entropy, round(confidence, 4) AS confidence FROM w")
def peer_windows(t: Tables) -> DataFrame:
    return _windows(t).select("peer", "hour", F.round("rate", 6).alias("rate"), F.round(F.abs("entropy"), 6).alias("entropy"), F.round("confidence", 4).alias("confidence"))


@query(f"""WITH {WINDOWS}, v AS (SELECT peer, hour, rate, CASE WHEN peer = 3 THEN 0 ELSE entropy END AS entropy, confidence / 1000 AS confidence FROM w), b AS (SELECT peer, avg(rate) AS r, avg(entropy) AS e, avg(confidence) AS c FROM v GROUP BY 1)
SELECT v.peer, hour, rate >= 10 * r AS burst, e > 0 AND entropy <= 0.4 * e AS narrow, abs(confidence - c) >= 0.3 AS shift FROM v JOIN b ON b.peer = v.peer""")
def peer_anomaly(t: Tables) -> DataFrame:
    """One peer has a single type of event, so no entropy to fall from."""
    w = _windows(t).withColumns({"entropy": F.when(F.col("peer") == 3, 0.0).otherwise(F.col("entropy")), "confidence": F.col("confidence") / 1000})
    return crowd.peer_anomalies(w).select("peer", "hour", "burst", "narrow", "shift")


@query("SELECT user_id % 10 AS peer, round(0.5 * avg((event_type <> 'error')::INTEGER) + 0.5 * avg((value < 300)::INTEGER) FILTER (WHERE event_type <> 'error'), 9) AS health FROM events GROUP BY 1")
def peer_health(t: Tables) -> DataFrame:
    c = t.events().select((F.col("user_id") % 10).alias("peer"), (F.col("event_type") != "error").alias("ok"), (F.col("value") < 300).alias("valid"))
    return crowd.peer_health(c).select("peer", F.round("health", 9).alias("health"))


# --- privacy, functions ------------------------------------------------------


@query("""WITH x AS (SELECT user_id AS u, event_type || '/' || strftime(ts, '%Y-%m-%d') AS cell, min(least(greatest(value, 5.0), 130.0)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY cell) AS r FROM x), g AS (SELECT DISTINCT event_type || '/' || strftime(ts, '%Y-%m-%d') AS cell FROM events)
SELECT g.cell, round(coalesce(sum(v), 0.0), 6) AS total, count(v)::BIGINT AS units FROM g LEFT JOIN k ON k.cell = g.cell AND r <= 8 GROUP BY 1""")
def dp_shaped_sum(t: Tables) -> DataFrame:
    cell = F.concat_ws("/", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("cell")
    e = t.events()
    w = t.spark.createDataFrame([("w1", 0, 1705363200000)], "window string, start_ms long, end_ms long")
    tuples = e.select(F.col("user_id").alias("unit"), cell, F.col("value").alias("speed"), F.unix_millis("ts").alias("ts_ms"))
    out = privacy.release(privacy.shaped(privacy.in_windows(tuples, w), 5.0, 130.0, 8), e.select(cell).distinct())
    return out.select("cell", F.round("total", 6).alias("total"), "units")


@query("SELECT p_partkey, (p_size + 40)::DOUBLE * CASE WHEN p_partkey % 3 = 0 THEN 1.609344::DOUBLE ELSE 1.0::DOUBLE END AS kph FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 5 = 0")
def maxspeed_parse(t: Tables) -> DataFrame:
    s = F.when(F.col("p_partkey") % 5 == 0, F.lit("signals")).when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_size") + 40).cast("string"), F.lit(" mph"))).when(F.col("p_partkey") % 3 == 1, (F.col("p_size") + 40).cast("string")).otherwise(F.concat((F.col("p_size") + 40).cast("string"), F.lit(" km/h")))
    return t.read("part").select("p_partkey", S.maxspeed_kph(s).alias("kph"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS from_s, floor(epoch(ts))::BIGINT AS from_ms FROM events")
def instant_coercion(t: Tables) -> DataFrame:
    e = t.events()
    s, ms = F.unix_seconds("ts").cast("string"), (F.unix_seconds("ts") * 1000).cast("string")
    return e.select("event_id", F.unix_seconds(S.instant(s)).alias("from_s"), F.unix_seconds(S.instant(ms)).alias("from_ms"))


# --- streams: closed windows of the same input equal the batch ----------------


def _stream(t: Tables) -> DataFrame:
    """The events table as a stream."""
    path = f"{t.sf_dir}/event[s].parquet"  # a pattern, as a stream's path is else a folder
    s = jobs.stream_parquet(t.spark, path, t.read("events").schema)
    return s.where("value > 0 and value < 250").select(F.col("user_id").alias("sensor_key"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("value").alias("speed_kph"), "event_id")


CLOSED = "(SELECT max(ts) - INTERVAL 6 HOUR FROM events WHERE value > 0 AND value < 250)"


@query(f"""WITH {BINS} SELECT sensor_key, epoch(hour)::BIGINT AS hour, bin, c FROM bins WHERE hour + INTERVAL 1 HOUR <= {CLOSED}""")
def stream_tumbling_counts(t: Tables) -> DataFrame:
    got = jobs.run_to_table(jobs.hourly_bins(_stream(t)), "tumbling")
    return got.select("sensor_key", secs("hour").alias("hour"), "bin", "c")


@query("SELECT sensor_key, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id AS sensor_key, ts FROM events WHERE value > 0 AND value < 250) GROUP BY 1")
def stream_dedup(t: Tables) -> DataFrame:
    got = jobs.run_to_table(jobs.first_seen(_stream(t), ["sensor_key", "observed_at"]), "dedup")
    return got.groupBy("sensor_key").agg(F.count("*").alias("n"))
