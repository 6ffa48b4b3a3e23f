"""Scenarios: boundaries, ties and invariants of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.operators import changes, crowd, read, resolution, speed
from wayloom.sinks import emit
from wayloom.sources import formats


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.9,), (2.0,), (93.0,), (900.0,), (float("nan"),)], "v double")
    assert [r.b for r in df.select(S.speed_bin(F.col("v")).alias("b")).collect()] == [0, 0, 1, 46, 127, 0]


def test_sunday_is_zero(spark):
    assert spark.sql("select timestamp '2024-01-07 00:00:00' t").select(S.dow0(F.col("t")).alias("d")).first().d == 0


def test_histograms_merge(spark):
    rows = [(1, ts("2024-01-01 10:05:00"), float(v), "a") for v in (3, 5, 5, 90)]
    s = spark.createDataFrame(rows, "sensor_key long, observed_at timestamp, speed_kph double, source string")
    h = speed.hourly_histogram(s)
    r = h.first()
    assert (r.speed_bins, r.speed_counts, r.sample_count) == ([1, 2, 45], [1, 2, 1], 4)
    p = speed.histogram_percentile(speed.unnested(h), ["sensor_key"], "0.5", "p", 1).first()
    assert p.p == 5.0


def test_median_below_least_samples_is_absent(spark):
    s = spark.createDataFrame([(1, ts("2024-01-01 10:05:00"), 50.0, "a")], "sensor_key long, observed_at timestamp, speed_kph double, source string")
    assert speed.baselines(speed.bin_counts(s), 2).count() == 0


def test_diff_round_trip(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, v string")
    new = spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "id long, v string")
    d = changes.diff(old, new, "id", ["v"])
    assert {r.id: r.change for r in d.collect()} == {1: "deleted", 2: "unchanged", 3: "updated", 4: "inserted"}
    assert sorted(map(tuple, changes.apply_diff(old, d, "id", ["v"]).collect()), key=str) == sorted([(2, None), (3, "d"), (4, "e")], key=str)
    assert changes.outbox(d, False, F.lit(False)).count() == 0


def test_guards():
    assert changes.guard_swap(10, 0, True, 0, 1) == "empty flow"
    assert changes.guard_swap(10, 4, False, 0, 1) == "shrank too far"
    assert changes.guard_swap(10, 9, False, 2, 3) == "too many parts failed"
    assert changes.guard_swap(10, 9, False, 0, 3) is None


def test_live_needs_a_later_end(spark):
    now = ts("2024-01-01 00:00:00")
    rows = [(1, "active", now, None), (2, "active", now + dt.timedelta(seconds=1), None), (3, "active", None, None), (4, "archived", None, None)]
    df = spark.createDataFrame(rows, "id long, status string, valid_to timestamp, expires_at timestamp")
    assert sorted(r.id for r in df.where(read.live(F.lit(now))).collect()) == [2, 3]


def test_bbox_over_antimeridian():
    with pytest.raises(ValueError):
        read.checked_bbox(170, 0, -170, 10)


def test_chain_does_not_merge(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "i long, j long, metres double")
    got = {r.idx: r.cluster for r in resolution.complete_linkage(e).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3


def test_own_confirmation_does_not_corroborate(spark):
    t = ts("2024-01-01 10:00:00")
    rows = [("o", 1, t, "report", 7, None), ("o", 2, t, "confirm", 7, None), ("p", 3, t, "report", 7, None), ("p", 4, t, "confirm", 8, None)]
    led = spark.createDataFrame(rows, "obs string, id long, at timestamp, kind string, actor long, outcome string")
    got = {r.obs: r.state for r in crowd.evidence_state(led, F.lit(ts("2024-01-01 10:10:00"))).collect()}
    assert got == {"o": "self_reported", "p": "corroborated"}
    late = {r.obs: r.state for r in crowd.evidence_state(led, F.lit(ts("2024-01-01 10:30:00"))).collect()}
    assert set(late.values()) == {"expired"}


def test_beta_quantile():
    import numpy as np

    q = crowd.beta_quantile(np.array([1.0, 2.0]), np.array([1.0, 2.0]), 0.05)
    assert abs(q[0] - 0.05) < 1e-6 and abs(crowd.beta_cdf(q, np.array([1.0, 2.0]), np.array([1.0, 2.0]))[1] - 0.05) < 1e-6


def test_geojson_parser_and_emitter(spark):
    doc = '{"features":[{"properties":{"k":"a","t":"roadworks"},"geometry":{"type":"LineString","coordinates":[[4.5,52.0],[4.6,52.1]]}},{"properties":{"k":"b"}}]}'
    raw = spark.createDataFrame([(doc,), ("not json",)], "value string")
    got = formats.mapped_geojson(raw, "x", {"id": "properties.k", "type": "properties.t"})
    assert [(r.id, r.type, r.lon, r.lat) for r in got.collect()] == [("x:a", "roadworks", 4.5, 52.0)]
    assert '"coordinates":[4.5,52.0]' in emit.geojson_features(got, ["type"]).first().value


def test_measured_ties_keep_the_first(spark):
    rows = [("s", 50.0, 3, None, 0, False), ("s", 60.0, 3, 100.0, 1, False), ("s", 70.0, 9, None, 2, True), ("s", 300.0, 9, None, 3, False)]
    df = spark.createDataFrame(rows, "site string, speed double, inputs int, free_flow double, ord int, error boolean")
    assert tuple(formats.measured_sites(df).first()) == ("s", 50.0, 100.0)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_pairs_two_cells_apart_within_the_radius(spark):
    t = ts("2024-01-01 10:00:00")
    rows = [(1, 4.0005, 50.00190, "x", "a", "A1", t, 1, 1), (2, 4.0005, 50.00405, "x", "b", "A1", t, 2, 1)]
    p = spark.createDataFrame(rows, "idx long, lon double, lat double, type string, source string, road string, ts timestamp, actor long, direction int")
    assert [(r.i, r.j, r.reasons) for r in resolution.matches(p).collect()] == [(1, 2, [])]
    assert [(r.i, r.j) for r in resolution.cross_source_edges(p, strict=True).collect()] == [(1, 2)]
    assert resolution.cross_source_edges(p).isEmpty()


def test_linkage_of_a_long_chain(spark):
    """A component of 150 hops whose numbers go up and down: every node once, as by the greedy pass over all edges."""
    order = [x for k in range(75) for x in (k, 149 - k)]
    edges = sorted((min(a, b), max(a, b)) for step in (1, 2) for a, b in zip(order, order[step:]))
    home, members = {n: n for n in order}, {n: [n] for n in order}
    for a, b in edges:
        x, y = sorted((home[a], home[b]))
        if x != y and all((min(p, q), max(p, q)) in set(edges) for p in members[x] for q in members[y]):
            members[x] += members.pop(y)
            home |= dict.fromkeys(members[x], x)
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "i long, j long, metres double")
    got = [(r.idx, r.cluster) for r in resolution.complete_linkage(e).collect()]
    assert sorted(got) == sorted(home.items())


def test_coreporting_in_blocks(spark, monkeypatch):
    """Over several blocks, dense and sparse, by numbers and names: as counted pair by pair; no pair of actors is shuffled."""
    import itertools
    import random
    from collections import Counter

    rnd = random.Random(7)
    rows = [(rnd.randrange(60), f"t{rnd.randrange(8)}") for _ in range(400)] + [(100 + k, f"u{k // 3}") for k in range(40)] + [(None, "t1"), (3, None)]
    things = {}
    for a, x in rows:
        if a is not None and x is not None:
            things.setdefault(x, set()).add(a)
    pairs = Counter(p for s in things.values() for p in itertools.combinations(sorted(s), 2))
    df = spark.createDataFrame(rows, "actor long, thing string")
    for size in (4096, 7):
        monkeypatch.setattr(crowd, "BLOCK", size)
        for least in (1, 3):
            got = crowd.coreporting(df, least)
            assert {(r.first, r.second): r.shared for r in got.collect()} == {p: n for p, n in pairs.items() if n >= least}
    names = crowd.coreporting(df.withColumn("actor", F.concat(F.lit("\u00e9"), F.col("actor").cast("string"))), 2)
    assert {(r.first, r.second) for r in names.collect()} == {tuple(sorted((f"\u00e9{a}", f"\u00e9{b}"))) for (a, b), n in pairs.items() if n >= 2}
    assert names._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    assert [f.dataType.simpleString() for f in names.schema] == ["string", "string", "bigint"]


def above_the_pairs(df):
    """The plan down to its first join: what is done with pairs once they are made."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_cross_source_pairs_of_copies(spark, monkeypatch):
    """Copies beyond one row of members: all pairs of rows, made where they meet."""
    monkeypatch.setattr(resolution, "CHUNK", 3)
    monkeypatch.setattr(resolution, "MOST_MEMBERS", 5)
    rows = [(k, 4.0 + k % 2 * 0.0003, 50.0 + k % 5 * 0.0009, "x", "ab"[k % 3 == 0], [None, "A1", "A2"][k % 7 % 3]) for k in range(70)]
    p = spark.createDataFrame(rows, "idx long, lon double, lat double, type string, source string, road string")
    got = resolution.cross_source_edges(p, strict=True)
    assert all(x not in above_the_pairs(got) for x in ("Aggregate", "Repartition", "Sort"))
    far = {(r.i, r.j): r.m for r in p.select(*[F.col(c).alias(f"{c}1") for c in p.columns], F.col("idx").alias("i")).crossJoin(p.withColumn("j", F.col("idx"))).where("i < j").select("i", "j", S.haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon"), F.col("lat")).alias("m")).collect()}
    want = {(i, j) for (i, j), m in far.items() if rows[i][4] != rows[j][4] and (m <= 75 or m <= 250 and rows[i][5] and rows[i][5] == rows[j][5]) and not (rows[i][5] and rows[j][5] and rows[i][5] != rows[j][5])}
    pairs = [(r.i, r.j) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_clusters_of_copies(spark):
    """Copies take part as one: the same clusters as the greedy pass over all edges of all rows."""
    import random

    rnd = random.Random(3)
    rows = [(k, 4.0 + rnd.randrange(6) * 0.0007, 50.0 + rnd.randrange(3) * 0.0006, "x", rnd.choice("ab"), rnd.choice([None, None, "north gate", "gate north", "!!"])) for k in rnd.sample(range(500), 90)]
    p = spark.createDataFrame(rows, "idx long, lon double, lat double, type string, source string, label string").checkpoint()
    edges = sorted((r.i, r.j) for r in resolution.same_source_edges(p, 80.0).collect())
    home, members = {n: n for e in edges for n in e}, {n: [n] for e in edges for n in e}
    for a, b in edges:
        x, y = sorted((home[a], home[b]))
        if x != y and all((min(u, v), max(u, v)) in set(edges) for u in members[x] for v in members[y]):
            members[x] += members.pop(y)
            home |= dict.fromkeys(members[x], x)
    got = [(r.idx, r.cluster) for r in resolution.same_source_clusters(p, 80.0).collect()]
    assert sorted(got) == sorted(home.items())


def test_keys_around_are_fingerprints(spark):
    """Every key is the fingerprint at its offsets, with odd names and missing values too; nothing is shuffled by key."""
    t = ts("2024-01-01 10:00:00")
    rows = [(1, 4.0005, 50.0019, 'ro"ads', "x\\é", t), (2, None, 89.9, None, "y", t), (3, -0.0005, -0.0004, "roads", "", None)]
    e = spark.createDataFrame(rows, "id long, lon double, lat double, domain string, type string, ts timestamp")
    got = {(r.id, r.key) for r in resolution.neighbourhood(e, 100.0, 300).collect()}
    f = [resolution.fingerprint(F.col("lon"), F.col("lat"), F.col("domain"), F.col("type"), F.col("ts"), dx=x, dy=y, dt=k) for x in (-2, -1, 0, 1, 2) for y in (-1, 0, 1) for k in (-1, 0, 1)]
    want = {(r.id, r.key) for r in e.where("id <> 2").select("id", F.explode(F.array(*f)).alias("key")).collect()}
    assert {x for x in got if x[0] == 1} == {x for x in want if x[0] == 1} and len([x for x in got if x[0] == 1]) == 45
    assert {x for x in got if x[0] == 3} <= {x for x in want if x[0] == 3} and any(x[0] == 3 for x in got)
    n = e.select("id", resolution.over_neighbourhood(lambda keys, _: len(set(keys)), "long", None, 100.0, 300).alias("n"))
    assert n.where("id = 1").first().n == 45
    assert "Exchange" not in n._jdf.queryExecution().executedPlan().toString()


def test_geometry_and_label_pairs_are_not_shuffled(spark):
    """Pairs are made where they meet, those of copies too."""
    g = spark.range(6).selectExpr("id AS idx", "array(struct(4.0D AS lon, 50.0D AS lat), struct(4.003D AS lon, 50.0D AS lat)) AS points", "'x' AS type", "string(id % 2) AS source", "array('A1') AS roads")
    w = spark.range(6).selectExpr("id AS idx", "'b' AS block", "array('red', string(id % 2)) AS words")
    pairs, words = resolution.geometry_edges(g), resolution.similar_labels(w, 0.5)
    assert all(x not in above_the_pairs(df) for df in (pairs, words) for x in ("Aggregate", "Repartition", "Sort"))
    assert sorted((r.i, r.j) for r in pairs.collect()) == [(a, b) for a in range(6) for b in range(a + 1, 6) if (b - a) % 2]
    assert sorted((r.i, r.j) for r in words.collect()) == [(a, b) for a in range(6) for b in range(a + 1, 6) if (b - a) % 2 == 0]
