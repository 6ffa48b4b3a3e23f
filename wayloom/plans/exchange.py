"""Queries on peers, reports, evidence and streams with state, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators import crowd, federation, reports, resolution
from wayloom.plans.adapters import OBS, OBS_NOW, Tables, haversine
from wayloom.plans.registry import query
from wayloom.streaming import jobs

AT = f"TIMESTAMP '{OBS_NOW}'"


def obs_now():
    return F.lit(OBS_NOW).cast("timestamp")


# --- federation --------------------------------------------------------------

JOURNAL = f"""{OBS}, j AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'delete' ELSE 'update' END AS operation, CASE id % 5 WHEN 0 THEN 'self_reported' WHEN 1 THEN 'corroborated' WHEN 2 THEN 'externally_resolved' WHEN 3 THEN 'negated' END AS evidence_state,
  CASE WHEN id % 13 <> 0 THEN valid_from END AS updated_at, CASE id % 4 WHEN 0 THEN 'road_closure' WHEN 1 THEN 'accident' WHEN 2 THEN 'hazard' END AS t, CASE id % 7 WHEN 0 THEN 'authoritative' WHEN 1 THEN 'k_anon' END AS pc, id % 50 AS txid FROM obs)"""


def _journal(t: Tables) -> DataFrame:
    k = F.col("id")
    return t.obs().withColumns(
        {
            "operation": F.when(k % 9 == 0, "delete").otherwise("update"),
            "evidence_state": F.when(k % 5 == 0, "self_reported").when(k % 5 == 1, "corroborated").when(k % 5 == 2, "externally_resolved").when(k % 5 == 3, "negated"),
            "updated_at": F.when(k % 13 != 0, F.col("valid_from")),
            "type": F.when(k % 4 == 0, "road_closure").when(k % 4 == 1, "accident").when(k % 4 == 2, "hazard"),
            "privacy_class": F.when(k % 7 == 0, "authoritative").when(k % 7 == 1, "k_anon"),
            "txid": k % 50,
            "seq": k,
        }
    )


@query(f"""WITH {JOURNAL} SELECT id FROM j WHERE operation = 'delete' OR ((origin_kind <> 'crowd' OR evidence_state IN ('corroborated', 'externally_resolved')) AND {AT} - updated_at <= INTERVAL 1 SECOND * 100000000
  AND lon BETWEEN 4.2::DOUBLE AND 5.0::DOUBLE AND lat BETWEEN 50.2::DOUBLE AND 51.0::DOUBLE AND t IN ('accident', 'hazard') AND coalesce(pc, 'unknown') IN ('authoritative', 'unknown'))""")
def federation_filtered(t: Tables) -> DataFrame:
    return federation.federation_filter(_journal(t), obs_now(), "corroborated", 100_000_000, (4.2, 50.2, 5.0, 51.0), ["accident", "hazard"], ["authoritative", "unknown"]).select("id")


@query(f"WITH {JOURNAL} SELECT id FROM j WHERE operation = 'delete' OR t IN ('road_closure', 'accident')")
def priority_entries(t: Tables) -> DataFrame:
    return federation.priority(_journal(t)).select("id")


@query(f"WITH {JOURNAL} SELECT id, txid || '.' || id AS cursor FROM j WHERE txid < 40 AND (txid > 7 OR (txid = 7 AND id > 1000)) ORDER BY txid, id LIMIT 100")
def change_feed_page(t: Tables) -> DataFrame:
    return federation.feed_page(_journal(t), (7, 1000), 40).select("id", "cursor")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey END AS txid, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey END AS seq FROM orders")
def cursor_round_trip(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 < 2, federation.cursor(F.col("o_custkey"), k)).otherwise(F.concat(k.cast("string"), F.lit(".x")))
    c = federation.parsed_cursor(text)
    return t.read("orders").select(k.alias("id"), c.txid.cast("long").alias("txid"), c.seq.alias("seq"))


@query("""SELECT s_suppkey, substr(sha256('{"a":"' || s_name || '","b":' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ',"c":1' ELSE '' END || '}'), 1, 16) AS etag FROM supplier""")
def etags(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.read("supplier").select("s_suppkey", F.when(k % 2 == 0, 1).alias("c"), k.alias("b"), F.col("s_name").alias("a"))
    return rows.select("s_suppkey", federation.etag(federation.canonical_json(["c", "b", "a"])).alias("etag"))


@query(f"""WITH {OBS}, p AS (SELECT id, CASE WHEN id % 17 = 0 THEN NULL WHEN id % 11 = 0 THEN 'other' ELSE 'peer' END AS inst, CASE WHEN id % 7 <> 0 THEN 'c' || id END AS cid, CASE WHEN id % 5 = 0 THEN 'odd' ELSE 'k_anon' END AS pc,
  CASE id % 4 WHEN 0 THEN 'weird' WHEN 1 THEN 'expired' END AS es, CASE WHEN id % 19 = 0 THEN 'relay' ELSE origin_kind END AS ok, (id % 12) / 10.0 AS score, (id % 10) / 9.0 AS delta, id % 6 AS k FROM obs)
SELECT id, concat_ws(',', CASE WHEN inst IS NULL THEN 'no instance' WHEN inst <> 'peer' THEN 'relayed' END, CASE WHEN cid IS NULL THEN 'no canonical id' END, CASE WHEN pc = 'odd' THEN 'privacy class' END, CASE WHEN es = 'weird' THEN 'evidence state' END,
  CASE WHEN ok = 'relay' THEN 'origin' END, CASE WHEN score > 1 THEN 'confidence_score' END, CASE WHEN delta >= 1 THEN 'dp_delta' END, CASE WHEN k = 0 THEN 'k_anonymity' END) AS rejected FROM p""")
def peer_rows_checked(t: Tables) -> DataFrame:
    k = F.col("id")
    rows = t.obs().select(
        "id", F.when(k % 17 == 0, None).when(k % 11 == 0, "other").otherwise("peer").alias("instance_id"), F.when(k % 7 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("canonical_id"), F.when(k % 5 == 0, "odd").otherwise("k_anon").alias("privacy_class"),
        F.when(k % 4 == 0, "weird").when(k % 4 == 1, "expired").alias("evidence_state"), F.when(k % 19 == 0, "relay").otherwise(F.col("origin_kind")).alias("origin_kind"), (k % 12 / 10.0).alias("confidence_score"), F.lit(0.5).alias("dp_epsilon"), (k % 10 / 9.0).alias("dp_delta"), (k % 6).cast("double").alias("k_anonymity"), F.lit("r").alias("reporter"),
    )
    return federation.checked_peer_rows(rows, "peer").select("id", F.array_join("rejected", ",").alias("rejected"))


@query(f"""WITH {OBS} SELECT id, sha256('["' || lower(trim(source)) || '","' || id || '"]') AS canonical_id, concat_ws(',', CASE WHEN id % 5 = 1 THEN 'privacy_class' END, CASE WHEN id % 6 = 0 THEN 'evidence_state' END) AS rejected FROM obs""")
def provenance_stamped(t: Tables) -> DataFrame:
    k = F.col("id")
    rows = t.obs().select("id", "source", F.when(k % 5 == 1, "k_anon").when(k % 5 == 2, "authoritative").alias("privacy_class"), F.when(k % 3 == 0, "here").alias("instance_id"), F.when(k % 6 == 0, "expired").alias("evidence_state"))
    return federation.stamped(rows, "here", "feed").select("id", "canonical_id", F.array_join("rejected", ",").alias("rejected"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'a/b' WHEN s_suppkey % 3 = 1 THEN 'x/y,a/b' ELSE 'a/b,x/y' END AS chain, CASE WHEN s_suppkey % 2 = 0 THEN 'sse,push' ELSE 'push' END AS agreed FROM supplier")
def chains_and_capabilities(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    link = lambda a, b: F.struct(F.lit(a).alias("instance"), F.lit(b).alias("peer"))
    chain = F.when(k % 3 == 1, F.array(link("x", "y"))).when(k % 3 == 2, F.array(link("a", "b"), link("x", "y")))
    out = federation.origin_chain(chain, F.lit("a"), F.lit("b"))
    theirs = F.when(k % 2 == 0, F.array(F.lit("push"), F.lit("sse"))).otherwise(F.array(F.lit("push"), F.lit("inbox")))
    return t.read("supplier").select("s_suppkey", F.array_join(F.transform(out, lambda x: F.concat_ws("/", x.instance, x.peer)), ",").alias("chain"), F.array_join(federation.agreed(F.array(F.lit("sse"), F.lit("poll"), F.lit("push")), theirs), ",").alias("agreed"))


@query("SELECT DISTINCT 'lic-' || (o_custkey % 9) AS license FROM orders WHERE o_custkey % 2 = 0")
def licence_list(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    return federation.licences(t.read("orders").select(F.when(k % 2 == 0, F.concat(F.lit("lic-"), (k % 9).cast("string"))).alias("license")))


@query(f"""WITH {OBS}, r AS (SELECT id, CASE WHEN id % 14 = 0 THEN 'gdpr_erasure' ELSE 'withdrawn' END AS reason FROM obs WHERE id % 7 = 0)
SELECT o.id, CASE WHEN r.id IS NOT NULL THEN 'archived' ELSE status END AS status, CASE WHEN r.id IS NULL OR status = 'archived' THEN severity END AS severity, CASE WHEN status <> 'archived' THEN reason END AS tombstone_reason FROM (SELECT id, severity, CASE WHEN id % 10 = 0 THEN 'archived' ELSE status END AS status FROM obs) o LEFT JOIN r USING (id)""")
def soft_tombstones(t: Tables) -> DataFrame:
    k = F.col("id")
    obs = t.obs().select("id", "severity", F.when(k % 10 == 0, "archived").otherwise(F.col("status")).alias("status"), k.cast("string").alias("canonical_id"))
    asked = obs.where("id % 7 = 0").select("id", F.when(k % 14 == 0, "gdpr_erasure").otherwise("withdrawn").alias("reason"))
    return federation.tombstoned(obs, asked, obs_now())[0].select("id", "status", "severity", "tombstone_reason")


@query(f"""WITH {JOURNAL} SELECT id, operation, CASE WHEN operation = 'delete' OR cust % 6 <> 0 THEN severity END AS severity FROM j""")
def journal_scrubbed(t: Tables) -> DataFrame:
    j = _journal(t).withColumn("object_id", F.col("cust"))
    asked = j.select(F.col("cust").alias("id"), F.when(F.col("cust") % 6 == 0, "gdpr_erasure").otherwise("withdrawn").alias("reason"))
    return federation.scrubbed(j, asked, ["severity"]).select("id", "operation", "severity")


@query(f"""WITH {OBS}, held AS (SELECT id, id % 40 AS cid, 'h' || (id % 35) AS ch, CASE id % 3 WHEN 0 THEN 'peer' WHEN 1 THEN 'here' ELSE 'third' END AS inst, valid_from AS u FROM obs WHERE id % 8 = 0 AND id < 400),
arr AS (SELECT id, 20 + id % 60 AS cid, 'h' || (10 + id % 50) AS ch FROM obs WHERE id % 4 = 0 AND id < 1600),
n AS (SELECT cid, arg_max(id, (u, id)) AS id, arg_max(inst, (u, id)) AS inst FROM held GROUP BY 1), c AS (SELECT ch, arg_max(id, (u, id)) AS id, arg_max(inst, (u, id)) AS inst FROM held GROUP BY 1),
x AS (SELECT a.id, a.cid BETWEEN 30 AND 32 AS dead, coalesce(n.id, c.id) AS target, CASE WHEN n.id IS NOT NULL THEN n.inst ELSE c.inst END AS inst, h.id IS NOT NULL AS taken FROM arr a LEFT JOIN n USING (cid) LEFT JOIN c ON c.ch = a.ch LEFT JOIN held h ON h.id = a.id)
SELECT id, CASE WHEN dead THEN 'tombstoned' WHEN target IS NOT NULL AND inst IN ('peer', 'here') THEN 'resupplied' WHEN target IS NOT NULL THEN 'non-owned-collision' WHEN taken THEN 'id-conflict' ELSE 'inserted' END AS outcome, CASE WHEN NOT dead AND inst IN ('peer', 'here') THEN target END AS target FROM x""")
def resupply_outcomes(t: Tables) -> DataFrame:
    k = F.col("id")
    o = t.obs()
    held = o.where("id % 8 = 0 and id < 400").select("id", (k % 40).alias("canonical_id"), F.concat(F.lit("h"), (k % 35).cast("string")).alias("content_hash"), F.when(k % 3 == 0, "peer").when(k % 3 == 1, "here").otherwise("third").alias("instance_id"), F.col("valid_from").alias("updated_at"))
    arriving = o.where("id % 4 = 0 and id < 1600").select("id", (20 + k % 60).alias("canonical_id"), F.concat(F.lit("h"), (10 + k % 50).cast("string")).alias("content_hash"), F.lit("peer").alias("instance_id"))
    facts = t.spark.range(30, 36).select(F.col("id").alias("canonical_id"), F.when(F.col("id") < 33, F.lit("2030-01-01")).otherwise(F.lit("1990-01-01")).cast("timestamp").alias("expires_at"))
    return federation.resupplied(arriving, held, facts, obs_now(), "here")


@query("""WITH a AS (SELECT user_id AS sub, ts, event_id, event_type <> 'error' AS ok FROM events), r AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY sub ORDER BY ts, event_id) AS run FROM a),
g AS (SELECT sub, run, count(*) FILTER (WHERE NOT ok) AS f FROM r GROUP BY 1, 2) SELECT sub, arg_max(f, run)::BIGINT AS failures, max(f) >= 2 AS disabled FROM g GROUP BY 1""")
def webhook_states(t: Tables) -> DataFrame:
    a = t.events().select(F.col("user_id").alias("sub"), F.struct("ts", "event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return federation.deliveries(a, 2)


# --- reports -----------------------------------------------------------------


@query(f"""SELECT event_id, concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'reported_at_invalid' WHEN epoch_us(TIMESTAMP '2024-01-16') - epoch_us(ts) > 86400000000 THEN 'reported_at_stale' WHEN epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-16') > 300000000 THEN 'reported_at_future' END,
  CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'nonce_malformed' END) AS reasons FROM events""")
def claim_plausibility(t: Tables) -> DataFrame:
    k = F.col("event_id")
    nonce = F.when(k % 5 == 0, F.lit("short")).when(k % 7 != 0, F.concat(F.lit("abcdefghij_-0123456"), k.cast("string")))
    at = F.when(k % 11 != 0, F.col("ts"))
    return t.events().select("event_id", F.array_join(reports.claim_reasons(at, F.lit("2024-01-16").cast("timestamp"), nonce), ",").alias("reasons"))


@query("""SELECT user_id, round(0.3 + CASE WHEN d >= 7 THEN 0.2 ELSE 0 END + CASE WHEN d >= 30 THEN 0.2 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 0.1 ELSE 0 END + CASE WHEN user_id % 4 > 0 AND v > 0 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS trust,
  round(2 + 0.25::DOUBLE * (v + 1 - 2), 6) AS alpha, round(2 + 0.25::DOUBLE * (e + 1 - 2), 6) AS beta
FROM (SELECT user_id, user_id % 40 AS d, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)""")
def trust_scores(t: Tables) -> DataFrame:
    u = F.col("user_id")
    g = t.events().groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("event_type") == "error").alias("e"))
    s = reports.trust(u % 40, u % 2 == 0, u % 3 == 0, u % 4 > 0, F.col("v"))
    a, b = reports.shrunk(F.col("v") + 1, F.col("e") + 1, F.lit(2), F.lit(2), 0.25)
    return g.select("user_id", F.round(s, 6).alias("trust"), F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"))


@query("""WITH r AS (SELECT event_id, user_id, ts, floor(value / 50) AS cell, (event_type <> 'error')::INTEGER AS ok FROM events)
SELECT event_id, (sum(ok) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) - ok)::BIGINT AS recent, (sum(ok) OVER (PARTITION BY user_id, cell ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) - ok)::BIGINT AS recent_here FROM r""")
def report_rate_by_cell(t: Tables) -> DataFrame:
    r = t.events().select("event_id", F.col("user_id").alias("actor"), F.col("ts").alias("at"), F.floor(F.col("value") / 50).alias("cell"), (F.col("event_type") != "error").alias("accepted"))
    return reports.rate_by_cell(r, 86400).select("event_id", "recent", "recent_here")


# Entries of the last four hours before now, five or so for each observation, so that all states occur.
LEDGER = """e AS (SELECT event_id // 6 AS obs, event_id AS id, (1704067200 + 14400 - (event_id * 7919) % 16000)::BIGINT AS tm, CASE WHEN event_id % 6 = 0 OR event_id % 13 = 0 THEN 'report' WHEN event_type = 'error' THEN 'negate' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'external' WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'cancel' ELSE 'confirm' END AS kind,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'confirmed' ELSE 'rejected' END END AS outcome, CASE WHEN event_id % 29 <> 0 THEN user_id % 7 END AS actor, (user_id % 11) / 10.0::DOUBLE AS bound FROM events)"""
LEDGER_NOW = 1704067200 + 14400


def _ledger(t: Tables) -> DataFrame:
    k, u, e = F.col("event_id"), F.col("user_id"), F.col("event_type")
    external = (e == "purchase") & (k % 3 == 0)
    kind = F.when((k % 6 == 0) | (k % 13 == 0), "report").when(e == "error", "negate").when(external, "external").when((e == "signup") & (k % 2 == 0), "cancel").otherwise("confirm")
    at = F.timestamp_seconds(F.lit(LEDGER_NOW) - (k * 7919) % 16000)
    return t.events().select(F.floor(k / 6).alias("obs"), k.alias("id"), at.alias("at"), kind.alias("kind"), F.when(external, F.when(k % 2 == 0, "confirmed").otherwise("rejected")).alias("outcome"), F.when(k % 29 != 0, u % 7).alias("actor"), (u % 11 / 10.0).alias("lower_bound"))


@query(f"""WITH {LEDGER},
f AS (SELECT obs, arg_min(id, (tm, id)) AS fid, arg_min(coalesce(actor, -1), (tm, id)) AS owner, min(tm) AS first_at, arg_min(bound, (tm, id)) AS bound FROM e WHERE kind = 'report' GROUP BY 1),
j AS (SELECT e.*, fid, nullif(owner, -1) AS owner, first_at, f.bound AS b FROM e JOIN f USING (obs)),
g AS (SELECT obs, min(first_at) AS first_at, min(b) AS b,
  count(DISTINCT actor) FILTER (WHERE (kind = 'confirm' OR (kind = 'report' AND id <> fid)) AND actor IS DISTINCT FROM owner) AS yes,
  count(DISTINCT actor) FILTER (WHERE kind IN ('negate', 'cancel') AND actor IS DISTINCT FROM owner) AS no,
  max(tm) FILTER (WHERE kind IN ('negate', 'cancel') AND actor IS NOT NULL AND actor IS DISTINCT FROM owner) AS negated_at,
  min(tm) FILTER (WHERE kind IN ('negate', 'cancel') AND actor = owner) AS gone,
  max(tm) FILTER (WHERE kind IN ('report', 'confirm')) AS positive_at,
  arg_max(outcome, (tm, id)) FILTER (WHERE kind = 'external') AS ext, max(tm) FILTER (WHERE kind = 'external') AS ext_at FROM j GROUP BY 1),
h AS (SELECT *, least(positive_at + 1800, first_at + 14400)::DOUBLE AS decay FROM g),
s AS (SELECT *, CASE WHEN ext = 'confirmed' THEN 'externally_resolved' WHEN ext = 'rejected' OR gone IS NOT NULL OR (no >= 2 AND no > yes) THEN 'negated' WHEN yes >= 1 THEN 'corroborated' ELSE 'self_reported' END AS state,
  CASE WHEN ext = 'confirmed' THEN least(ext_at + 1800, first_at + 14400) WHEN ext = 'rejected' THEN ext_at WHEN gone IS NOT NULL THEN gone WHEN no >= 2 AND no > yes THEN negated_at
    WHEN no > 0 AND decay - negated_at > 0 THEN least(decay, negated_at + (decay - negated_at) * pow(0.5, no)) ELSE decay END::DOUBLE AS expires_s FROM h),
x AS (SELECT *, CASE WHEN state <> 'negated' AND {LEDGER_NOW} >= expires_s THEN 'expired' ELSE state END AS final FROM s)
SELECT obs::BIGINT AS obs, final AS state, round(expires_s, 3) AS expires_s, yes::BIGINT AS confirmers, no::BIGINT AS negators, final = 'externally_resolved' AS routing_eligible,
  round(greatest(0, least(1, 0.1 * (b - 0.5) + CASE final WHEN 'externally_resolved' THEN 0.95 WHEN 'negated' THEN 0 WHEN 'expired' THEN 0
    ELSE greatest(0, least(1, 0.35 + 0.4 * (1 - pow(0.5, yes)) - 0.8 * (1 - pow(0.5, no)))) END)), 6)::DOUBLE AS score FROM x""")
def evidence_state(t: Tables) -> DataFrame:
    s = crowd.evidence_state(_ledger(t), F.timestamp_seconds(F.lit(LEDGER_NOW)))
    return s.select("obs", "state", F.round("expires_s", 3).alias("expires_s"), "confirmers", "negators", "routing_eligible", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT event_id, event_id % 90 AS subject, user_id % 20 AS actor, event_type AS type, ts FROM events), f AS (SELECT subject, actor, type, min((ts, event_id)) AS x FROM v GROUP BY ALL)
SELECT subject, actor, type, x[2] AS id FROM f WHERE subject % 4 NOT IN (0, 1)""")
def votes_cast(t: Tables) -> DataFrame:
    k = F.col("event_id")
    v = t.events().select((k % 90).alias("subject"), (F.col("user_id") % 20).alias("actor"), F.col("event_type").alias("type"), F.col("ts").alias("at"), k.alias("id"))
    s = t.spark.range(90).select(F.col("id").alias("subject"), F.when(F.col("id") % 4 == 0, "negated").when(F.col("id") % 4 == 1, "externally_resolved").otherwise("corroborated").alias("state"))
    return reports.cast_votes(v, s).select("subject", "actor", "type", "id")


@query(f"""WITH {LEDGER}, r AS (SELECT obs, 'official' AS source, CASE WHEN obs % 3 = 0 THEN 'rejected' ELSE 'confirmed' END AS outcome, 1704067200 + 9000 AS tm FROM (SELECT DISTINCT obs FROM e WHERE obs % 2 = 0)
  UNION ALL SELECT obs, 'reviewer', 'confirmed', 1704067200 + 5000 FROM (SELECT DISTINCT obs FROM e WHERE obs % 4 = 0)),
q AS (SELECT *, min(tm) OVER (PARTITION BY obs) AS cutoff FROM r),
f AS (SELECT obs, arg_min(coalesce(actor, -1), (tm, id)) AS owner FROM e WHERE kind = 'report' GROUP BY 1),
c AS (SELECT DISTINCT q.obs, q.source, q.outcome, e.actor FROM q JOIN e ON e.obs = q.obs AND e.kind = 'confirm' AND e.actor IS NOT NULL AND e.tm < q.cutoff LEFT JOIN f ON f.obs = q.obs WHERE f.owner IS NULL OR e.actor <> f.owner),
a AS (SELECT actor, outcome, 1 AS c FROM c UNION ALL SELECT owner, outcome, 0 FROM q JOIN f USING (obs) WHERE owner >= 0),
n AS (SELECT actor, count(*) FILTER (WHERE outcome = 'confirmed') AS yes, count(*) FILTER (WHERE outcome = 'rejected') AS no, count(*) FILTER (WHERE outcome = 'confirmed' AND c = 1) AS backed FROM a GROUP BY 1)
SELECT k.actor, 2 + coalesce(yes, 0) AS alpha, 2 + coalesce(no, 0) AS beta, coalesce(backed, 0) AS corroborated FROM range(9) k(actor) LEFT JOIN n ON n.actor = k.actor""")
def reputation_after_resolution(t: Tables) -> DataFrame:
    e = _ledger(t)
    obs = e.select("obs").distinct()
    at = lambda s: F.timestamp_seconds(F.lit(1704067200 + s)).alias("at")
    r = obs.where("obs % 2 = 0").select("obs", F.lit("official").alias("source"), F.when(F.col("obs") % 3 == 0, "rejected").otherwise("confirmed").alias("outcome"), at(9000))
    r = r.union(r).union(obs.where("obs % 4 = 0").select("obs", F.lit("reviewer"), F.lit("confirmed"), at(5000)))  # a resolution that comes twice counts once
    who = t.spark.range(9).select(F.col("id").alias("actor"), F.lit(2).alias("alpha"), F.lit(2).alias("beta"), F.lit(0).alias("corroborated"))
    return reports.resolve(e, r, who)


CROWD = """o AS (SELECT c_custkey AS id, c_custkey // 3 AS g, to_timestamp(1704067200 + (c_custkey * 37) % 3000) AS tm, c_custkey % 7 = 0 AS off FROM customer WHERE c_custkey < 600)"""


@query(f"""WITH {CROWD}, p AS (SELECT a.id AS x, b.id AS y, CASE WHEN (a.tm, a.id) < (b.tm, b.id) THEN a.id ELSE b.id END AS s, CASE WHEN (a.tm, a.id) < (b.tm, b.id) THEN b.id ELSE a.id END AS m FROM o a JOIN o b ON a.g = b.g AND a.id < b.id WHERE NOT a.off AND NOT b.off),
i AS (SELECT m, arg_min(s, (o.tm, o.id)) AS s FROM p JOIN o ON o.id = p.s GROUP BY 1)
SELECT o.id, CASE WHEN o.off OR i.m IS NOT NULL THEN 'inactive' ELSE 'active' END AS status, coalesce(l.c, '') AS corroborations FROM o LEFT JOIN i ON i.m = o.id LEFT JOIN (SELECT s, string_agg(m::VARCHAR, ',' ORDER BY m) AS c FROM i GROUP BY 1) l ON l.s = o.id""")
def corroboration(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    o = t.read("customer").where("c_custkey < 600").select(k.alias("id"), F.timestamp_seconds(F.lit(1704067200) + (k * 37) % 3000).alias("valid_from"), F.when(k % 7 == 0, "inactive").otherwise("active").alias("status"), F.array().cast("array<long>").alias("corroborations"), (k % 5).alias("actor"), F.lit("s").alias("source"), F.timestamp_seconds(k).alias("updated_at"))
    g = o.select("id", F.floor(F.col("id") / 3).alias("g"))
    m = g.alias("a").join(g.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"))
    none = t.spark.createDataFrame([], "obs long, about long, actor long, source string, at timestamp, kind string")
    return reports.corroborate(o, m, none)[0].select("id", "status", F.array_join("corroborations", ",").alias("corroborations"))


PLACES = "c_custkey AS id, 4.0::DOUBLE + (c_custkey % 31) * 0.0011::DOUBLE AS lon, 50.0::DOUBLE + (c_custkey % 29) * 0.0007::DOUBLE AS lat, c_mktsegment AS type, 1704067200 + (c_custkey * 37) % 3000 AS s"


@query(f"""WITH c AS (SELECT {PLACES} FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 9 <> 0), f AS (SELECT {PLACES} FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 <> 0)
SELECT c.id, min(f.id) AS feed_id FROM c JOIN f ON c.type = f.type AND abs(c.s - f.s) <= 900 AND {haversine('c.lon', 'c.lat', 'f.lon', 'f.lat')} <= 250 GROUP BY 1""")
def cross_validation(t: Tables) -> DataFrame:
    k = F.col("idx")
    p = t.read("customer").select(F.col("c_custkey").alias("idx"), (F.lit(4.0) + (F.col("c_custkey") % 31) * 0.0011).alias("lon"), (F.lit(50.0) + (F.col("c_custkey") % 29) * 0.0007).alias("lat"), F.col("c_mktsegment").alias("type"), F.timestamp_seconds(F.lit(1704067200) + (F.col("c_custkey") * 37) % 3000).alias("ts"), F.col("c_custkey").alias("actor"), F.lit(None).cast("string").alias("direction"))
    m = resolution.matches(p)
    both = m.select("i", "j", "reasons").union(m.select("j", "i", "reasons")).where("i % 2 = 0 and j % 2 = 1")
    people = p.where("idx % 2 = 0").select(k.alias("id"), F.when(k % 5 == 0, "inactive").otherwise("active").alias("status"), F.when(k % 9 == 0, F.col("ts")).alias("flagged_at"))
    feeds = p.where("idx % 2 = 1").select(k.alias("id"), F.when(k % 3 == 0, F.array(F.lit("peer"))).alias("origin_chain"))
    return reports.cross_validated(people, feeds, both)


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN ts END AS served FROM events) ORDER BY served NULLS FIRST, event_id LIMIT 500")
def sweep_oldest_first(t: Tables) -> DataFrame:
    e = t.events().select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("served"))
    return reports.oldest_first(e, "served", "event_id", 500).select("event_id")


@query("""WITH r AS (SELECT event_type AS source, event_id % 400 AS k, event_id AS ord, value FROM events), o AS (SELECT source, k, min(ord) AS ord, arg_max(value, ord) AS value FROM r GROUP BY 1, 2)
SELECT source, k, value FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS n FROM o) WHERE n <= 50""")
def rows_capped_by_source(t: Tables) -> DataFrame:
    r = t.events().select(F.col("event_type").alias("source"), (F.col("event_id") % 400).alias("k"), F.col("event_id").alias("ord"), "value")
    return reports.capped_by_source(r, "k", "ord", 50).select("source", "k", "value")


# --- streams with state ------------------------------------------------------


def _stream(t: Tables) -> DataFrame:
    return jobs.stream_parquet(t.spark, f"{t.sf_dir}/event[s].parquet", t.read("events").schema)


@query(f"""WITH f AS (SELECT event_id, user_id, ts, value / 50.0 AS lon, 50 + value / 500.0 AS lat FROM events),
p AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(h > 0 AND {haversine('plon', 'plat', 'lon', 'lat')} / 1000 / h > 400, FALSE) AS flagged FROM p""")
def stream_teleports(t: Tables) -> DataFrame:
    f = _stream(t).select(F.col("event_id").alias("id"), F.col("user_id").alias("actor"), F.col("ts").cast("timestamp").alias("at"), (F.col("value") / 50.0).alias("lon"), (50 + F.col("value") / 500.0).alias("lat"))
    return jobs.run_to_table(jobs.teleports(f), "teleports").select(F.col("id").alias("event_id"), "flagged")


@query("""WITH e AS (SELECT user_id, ts, sum(CASE WHEN ts - prev <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)),
g AS (SELECT user_id AS actor, min(ts) AS a, max(ts) AS b, count(*)::BIGINT AS n FROM e GROUP BY user_id, s)
SELECT actor, epoch_us(a) AS start_us, n FROM g WHERE b + INTERVAL 30 MINUTE < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_session_extension(t: Tables) -> DataFrame:
    """Sessions that the watermark has closed: those with half an hour of silence an hour before the stream's end."""
    s = jobs.sessions(_stream(t).select(F.col("user_id").alias("actor"), F.col("ts").cast("timestamp").alias("at")))
    got = jobs.run_to_table(s, "sessions")
    return got.select("actor", F.unix_micros("start").alias("start_us"), "n")


@query()
def stream_peer_limits(t: Tables) -> DataFrame:
    """Requests of peers through the limiter with its state; a plain replay in the tests gives the same."""
    k, u = F.col("event_id"), F.col("user_id")
    r = _stream(t).select((u % 5).alias("peer"), k.alias("id"), F.when(k % 3 == 0, "backfill").otherwise("inbox").alias("kind"), (F.lit(1704067200000) + k * 700).alias("ms"), (u % 5 % 3).cast("int").alias("tier"), (1 + k % 40).alias("size"))
    return jobs.run_to_table(jobs.peer_limiter(r), "peer-limits")
