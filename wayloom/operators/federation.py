"""Exchange with peers: filters, cursors, normalised rows, resupply, tombstones, capabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.read import envelope_overlaps

# Ranks of evidence states, types sent first, classes of privacy, states of evidence, reasons that erase.
TIER_RANK = {"self_reported": 1, "corroborated": 2, "externally_resolved": 3}
PRIORITY_TYPES = ["road_closure", "lane_closure", "accident"]
PRIVACY_CLASSES = ["authoritative", "aggregate", "k_anon", "dp_noised", "crowd_pseudonym"]
EVIDENCE_STATES = ["self_reported", "corroborated", "externally_resolved", "negated", "expired"]
ERASING = ["gdpr_erasure", "legal_takedown"]
WRITER_PRIVACY = {"feed": "authoritative", "crowd": "crowd_pseudonym"}


def federation_filter(entries: DataFrame, now: Column, min_tier: str = "corroborated", max_age_s: int | None = None, box: tuple[float, float, float, float] | None = None, types: list[str] | None = None, privacy: list[str] | None = None) -> DataFrame:
    """Journal entries a subscriber asks for; deletes always pass, as do entries without an observation.

    A crowd row needs at least the tier (a state without a rank never passes);
    a row without an update time is too old, one without a type has none of those asked for.
    """
    rank = F.coalesce(*[F.when(F.col("evidence_state") == s, r) for s, r in TIER_RANK.items()])
    keep = (F.coalesce("origin_kind", F.lit("")) != "crowd") | F.coalesce(rank >= TIER_RANK.get(min_tier, TIER_RANK["corroborated"]), F.lit(False))
    if max_age_s is not None:
        keep &= F.coalesce(F.unix_micros(now) - F.unix_micros("updated_at") <= max_age_s * 1_000_000, F.lit(False))
    if box is not None:
        keep &= F.coalesce(envelope_overlaps(*box), F.lit(False))
    if types is not None:
        keep &= F.coalesce(F.col("type").isin(types), F.lit(False))
    if privacy is not None:
        keep &= F.coalesce("privacy_class", F.lit("unknown")).isin(privacy)
    return entries.where((F.col("operation") == "delete") | keep)


def priority(entries: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Deletes, and entries of the types that are sent first."""
    return entries.where((F.col("operation") == "delete") | F.coalesce(F.col("type").isin(types or PRIORITY_TYPES), F.lit(False)))


def cursor(txid: Column, seq: Column) -> Column:
    return F.concat_ws(".", txid.cast("string"), seq.cast("string"))


def parsed_cursor(text: Column) -> Column:
    """(txid, seq) of a cursor's text, null if it is malformed."""
    ok = text.rlike(r"^[0-9]+\.[0-9]+$")
    return F.when(ok, F.struct(F.split(text, r"\.")[0].cast("decimal(20,0)").alias("txid"), F.split(text, r"\.")[1].cast("long").alias("seq")))


def feed_page(journal: DataFrame, after: tuple[int, int] | None, below_txid: int, size: int = 100, most: int = 500) -> DataFrame:
    """The next page of the change feed in order of (txid, seq): only transactions below the oldest one still open."""
    seen = journal.where(F.col("txid") < below_txid)
    if after is not None:
        seen = seen.where((F.col("txid") > after[0]) | ((F.col("txid") == after[0]) & (F.col("seq") > after[1])))
    return seen.orderBy("txid", "seq").limit(min(max(size, 1), most)).withColumn("cursor", cursor(F.col("txid"), F.col("seq")))


def etag(canonical: Column) -> Column:
    """The first 16 hex digits of the hash of a canonical text."""
    return F.substring(F.sha2(canonical, 256), 1, 16)


def canonical_json(columns: list[str]) -> Column:
    """JSON with keys in order of their names; null fields are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def stamped(rows: DataFrame, instance: str, kind: str) -> DataFrame:
    """Provenance of a local writer, set centrally; a row that asserts another is rejected: its reasons are in ``rejected``."""
    privacy = WRITER_PRIVACY[kind]
    reasons = [F.when(F.col("privacy_class") != privacy, "privacy_class"), F.when(F.col("instance_id") != instance, "instance_id")]
    reasons += [F.when(F.col(c).isNotNull(), c) for c in ("k_anonymity", "dp_epsilon", "dp_delta", "evidence_state", "routing_eligible") if c in rows.columns]
    out = rows.withColumn("rejected", F.array_compact(F.array(*reasons)))
    name = F.when(F.lit(kind) == "feed", F.col("source")).otherwise(F.lit(instance))
    identity = F.sha2(F.to_json(F.array(F.lower(F.trim(name)), F.col("id").cast("string"))), 256)
    return out.withColumns({"instance_id": F.lit(instance), "privacy_class": F.lit(privacy), "canonical_id": identity})


def checked_peer_rows(rows: DataFrame, peer: str) -> DataFrame:
    """Rows a peer sent, with ``rejected``: why a row must not be taken. The reporter and routing never come from a peer."""
    between = lambda c, lo, hi, open_hi: F.when(F.isnan(c) | (F.col(c) < lo) | ((F.col(c) >= hi) if open_hi else (F.col(c) > hi)), c)
    reasons = [
        F.when(F.coalesce("instance_id", F.lit("")) == "", "no instance").when(F.col("instance_id") != peer, "relayed"),
        F.when(F.coalesce("canonical_id", F.lit("")) == "", "no canonical id"),
        F.when(~F.coalesce(F.col("privacy_class").isin(PRIVACY_CLASSES), F.lit(False)), "privacy class"),
        F.when(~F.col("evidence_state").isin(EVIDENCE_STATES), "evidence state"),
        F.when(~F.coalesce(F.col("origin_kind").isin("feed", "crowd"), F.lit(False)), "origin"),
        between("confidence_score", 0, 1, False), between("dp_epsilon", 0, float("inf"), True), between("dp_delta", 0, 1, True), F.when(F.isnan("k_anonymity") | (F.col("k_anonymity") <= 0), "k_anonymity"),
    ]
    out = rows.withColumn("rejected", F.array_compact(F.array(*reasons)))
    return out.drop(*[c for c in ("reporter", "routing_eligible", "flagged_at") if c in rows.columns])


def origin_chain(chain: Column, instance: Column, peer: Column) -> Column:
    """The chain of (instance, peer) with one more at its end; of equal links the first stays."""
    return F.array_distinct(F.concat(F.coalesce(chain, F.array().cast("array<struct<instance:string,peer:string>>")), F.array(F.struct(instance.cast("string").alias("instance"), peer.cast("string").alias("peer")))))


def agreed(ours: Column, theirs: Column) -> Column:
    """Protocols or capabilities that both sides have, in our order."""
    return F.array_intersect(ours, theirs)


def licences(rows: DataFrame) -> DataFrame:
    """The distinct licences of the rows."""
    return rows.where("license is not null").select("license").distinct()


def tombstoned(obs: DataFrame, requests: DataFrame, now: Column, keep_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(observations, facts) after requests (id, reason): the row stays, archived and without its text; the fact by canonical id expires.

    Rows that are archived already stay as they are. Of several requests for a row the smallest reason counts.
    """
    ask = requests.groupBy("id").agg(F.min("reason").alias("tombstone_reason"))
    j = obs.join(ask, "id", "left")
    hit = F.col("tombstone_reason").isNotNull() & (F.col("status") != "archived")
    blank = [c for c in ("headline", "description", "subject", "label", "severity", "severity_level", "attributes", "reporter", "flagged_at") if c in obs.columns]
    out = j.withColumn("hit", hit).withColumns({"status": F.when(hit, "archived").otherwise(F.col("status")), **{c: F.when(~F.col("hit"), F.col(c)) for c in blank}})
    facts = j.where(hit & F.col("canonical_id").isNotNull()).groupBy("canonical_id").agg(F.min("tombstone_reason").alias("reason"))
    facts = facts.withColumns({"tombstoned_at": now, "expires_at": now + F.expr(f"interval {keep_days} days")})
    return out.withColumn("tombstone_reason", F.when(F.col("hit"), F.col("tombstone_reason"))).drop("hit"), facts


def scrubbed(journal: DataFrame, requests: DataFrame, text_columns: list[str]) -> DataFrame:
    """The journal without the texts of objects that are erased; deletes stay as they are."""
    erased = requests.where(F.col("reason").isin(ERASING)).select(F.col("id").alias("object_id")).distinct().withColumn("erased", F.lit(True))
    j = journal.join(erased, "object_id", "left")
    gone = F.col("erased").isNotNull() & (F.col("operation") != "delete")
    return j.withColumn("gone", gone).withColumns({c: F.when(~F.col("gone"), F.col(c)) for c in text_columns}).drop("gone", "erased")


def not_tombstoned(rows: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Rows whose canonical id has no living tombstone."""
    return rows.join(facts.where(F.col("expires_at") > now).select("canonical_id").distinct(), "canonical_id", "left_anti")


def resupplied(arriving: DataFrame, held: DataFrame, facts: DataFrame, now: Column, instance: str) -> DataFrame:
    """What becomes of each row of a peer: (id, outcome, target).

    A living tombstone refuses it. The same canonical id, else the same content
    (the latest such row), is a resupply of what is held, if the peer owns that or
    it is ours and the row came back; another owner's is a collision. An id held
    for something else is a conflict; what is left is inserted.
    """
    dead = facts.where(F.col("expires_at") > now).select("canonical_id").distinct().withColumn("dead", F.lit(True))
    by_name = held.groupBy("canonical_id").agg(F.max_by(F.struct("id", "instance_id"), F.struct("updated_at", "id")).alias("n"))
    by_content = held.where("content_hash is not null").groupBy("content_hash").agg(F.max_by(F.struct("id", "instance_id"), F.struct("updated_at", "id")).alias("c"))
    ids = held.select("id").distinct().withColumn("taken", F.lit(True))
    j = arriving.select("id", "canonical_id", "content_hash", "instance_id").join(dead, "canonical_id", "left").join(by_name, "canonical_id", "left").join(by_content, "content_hash", "left").join(ids, "id", "left")
    j = j.withColumn("t", F.coalesce("n", "c"))
    mine = (F.col("t.instance_id") == F.col("instance_id")) | (F.col("t.instance_id") == instance)
    outcome = F.when(F.col("dead"), "tombstoned").when(F.col("t").isNotNull() & mine, "resupplied").when(F.col("t").isNotNull(), "non-owned-collision").when(F.col("taken"), "id-conflict").otherwise("inserted")
    return j.select("id", outcome.alias("outcome"), F.when(outcome == "resupplied", F.col("t.id")).alias("target"))


def deliveries(attempts: DataFrame, threshold: int = 5) -> DataFrame:
    """State of each subscription after its attempts (sub, at, ok): failures in a row at the end, and whether it was disabled (so many in a row, ever)."""
    w = Window.partitionBy("sub").orderBy("at")
    runs = attempts.withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    per = runs.groupBy("sub", "run").agg(F.count_if(~F.col("ok")).alias("failures"))
    return per.groupBy("sub").agg(F.max_by("failures", "run").alias("failures"), (F.max("failures") >= threshold).alias("disabled"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
