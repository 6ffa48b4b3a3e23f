"""What people report: plausibility, trust, corroboration of one phenomenon, votes, resolutions that train reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.crowd import in_periods

# Seconds a claim may lie behind and ahead, its nonce, weights of trust, cut points of confidence.
MAX_PAST_S, MAX_FUTURE_S = 86_400, 300
NONCE = r"^[A-Za-z0-9_-]{16,64}$"
TRUST = {"base": 0.3, "days_7": 0.2, "days_30": 0.2, "attested": 0.1, "osm": 0.1, "history": 0.1}
CONFIDENCE = [(0.75, "observed"), (0.5, "likely"), (0.25, "possible")]
TERMINAL = ["externally_resolved", "negated"]


def claim_reasons(reported_at: Column, now: Column, nonce: Column) -> Column:
    """Why a claim can't be: its time is missing, stale or ahead; its nonce is malformed."""
    age = F.unix_micros(now) - F.unix_micros(reported_at)
    when = F.when(reported_at.isNull(), "reported_at_invalid").when(age > MAX_PAST_S * 1_000_000, "reported_at_stale").when(age < -MAX_FUTURE_S * 1_000_000, "reported_at_future")
    return F.array_compact(F.array(when, F.when(~F.coalesce(nonce.rlike(NONCE), F.lit(False)), "nonce_malformed")))


def confidence(score: Column) -> Column:
    out = F.lit("unknown")
    for least, name in reversed(CONFIDENCE):
        out = F.when(score >= least, name).otherwise(out)
    return out


def trust(tenure_days: Column, attested: Column, osm: Column, active: Column, corroborated: Column) -> Column:
    """Additive trust between 0 and 1."""
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    total = TRUST["base"] + yes(tenure_days >= 7, TRUST["days_7"]) + yes(tenure_days >= 30, TRUST["days_30"]) + yes(attested, TRUST["attested"]) + yes(osm, TRUST["osm"]) + yes(active & (corroborated > 0), TRUST["history"])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def shrunk(alpha: Column, beta: Column, cohort_alpha: Column, cohort_beta: Column, factor: float) -> tuple[Column, Column]:
    """A posterior pulled towards its cohort's: ``factor`` of the distance is kept, between 0 and 1."""
    if not 0 <= factor <= 1:
        raise ValueError("factor must be in [0, 1]")
    return cohort_alpha + factor * (alpha - cohort_alpha), cohort_beta + factor * (beta - cohort_beta)


def richness(points: Column, kind: Column, described: Column, roads: Column, lanes: Column, restrictions: Column, detour: Column) -> Column:
    """How much a record tells: vertices, a shape, a description, roads, lanes, restrictions, a detour."""
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), 2).otherwise(0)
    return points + yes(kind != "Point") + yes(described) + F.coalesce(roads, F.lit(0)) + yes(lanes) + F.coalesce(restrictions, F.lit(0)) + yes(detour)


def corroborate(obs: DataFrame, matches: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, evidence) after matches (i, j) of active rows: the earlier row of each pair survives.

    Earlier by (valid_from, id), a missing time last. The later row turns inactive
    and joins the survivor's lineage; the survivor gets its confirmation and copies
    of its confirmations, each observation once. A row that several pairs name
    goes to its earliest partner; chains are followed by resolution.survivor_chain.
    """
    active = obs.where("status = 'active'").select("id", F.struct(F.col("valid_from").isNull().cast("int").alias("u"), "valid_from", "id").alias("o"))
    pairs = matches.select(F.col("i").alias("a"), F.col("j").alias("b")).where("a <> b")
    pairs = pairs.join(active.withColumnsRenamed({"id": "a", "o": "oa"}), "a").join(active.withColumnsRenamed({"id": "b", "o": "ob"}), "b")
    into = pairs.select(F.least("oa", "ob").alias("s"), F.greatest("oa", "ob").alias("m")).groupBy("m").agg(F.min("s").alias("s")).select(F.col("m.id").alias("merged"), F.col("s.id").alias("survivor"))
    gone = into.select(F.col("merged").alias("id"), F.lit(True).alias("gone"))
    lineage = into.groupBy(F.col("survivor").alias("id")).agg(F.array_sort(F.collect_set("merged")).alias("more"))
    out = obs.join(gone, "id", "left").join(lineage, "id", "left")
    out = out.withColumns({"status": F.when(F.col("gone"), "inactive").otherwise(F.col("status")), "corroborations": F.array_union(F.coalesce("corroborations", F.array().cast(obs.schema["corroborations"].dataType)), F.coalesce("more", F.array().cast(obs.schema["corroborations"].dataType)))}).drop("gone", "more")
    own = into.join(obs.select(F.col("id").alias("merged"), "actor", "source", F.col("updated_at").alias("at")), "merged").select(F.col("survivor").alias("obs"), F.col("merged").alias("about"), "actor", "source", "at")
    confirms = evidence.where("kind = 'confirm'").select("obs", "about", "actor", "source", "at")
    copies = confirms.join(into.withColumnRenamed("merged", "obs"), "obs").select(F.col("survivor").alias("obs"), "about", "actor", "source", "at")
    first = own.unionByName(copies).groupBy("obs", "about").agg(F.min(F.struct("at", "actor", "source")).alias("x")).select("obs", "about", "x.actor", "x.source", "x.at")
    return out, insert_absent(evidence, first.withColumn("kind", F.lit("confirm")), ["obs", "kind", "about"])


def insert_absent(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` and those of ``more`` whose key isn't there yet; nulls are equal."""
    a, b = more.alias("a"), rows.select(*key).distinct().alias("b")
    same = F.lit(True)
    for k in key:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return rows.unionByName(a.join(b, same, "left_anti").select("a.*"))


def cross_validated(crowd: DataFrame, feeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, feed_id): the first compatible local feed row, by id, of each crowd row that isn't flagged and is active.

    candidates: (i, j, reasons) as of resolution.matches; a feed row with an origin chain is not local.
    """
    local = feeds.where("coalesce(size(origin_chain), 0) <= 0").select(F.col("id").alias("j"))
    own = crowd.where("status = 'active' and flagged_at is null").select(F.col("id").alias("i"))
    fit = candidates.where("size(reasons) = 0").join(local, "j").join(own, "i")
    return fit.groupBy(F.col("i").alias("id")).agg(F.min("j").alias("feed_id"))


def resolve(evidence: DataFrame, resolutions: DataFrame, reporters: DataFrame) -> DataFrame:
    """Reputations after external resolutions (obs, source, outcome, at): of the first reporter and of those who confirmed before.

    evidence: (obs, id, kind, actor, at). A resolution of an observation that had
    another before trains only those who confirmed before that; the same source
    and outcome resolves once. Confirmed adds to alpha, rejected to beta; a confirmer of
    a confirmed observation gains a corroboration.
    """
    once = resolutions.groupBy("obs", "source", "outcome").agg(F.min("at").alias("at"))
    once = once.withColumn("cutoff", F.min("at").over(Window.partitionBy("obs")))
    first = evidence.where("kind = 'report'").groupBy("obs").agg(F.min(F.struct("at", "id", "actor")).alias("f")).select("obs", F.col("f.actor").alias("owner"))
    said = evidence.where("kind = 'confirm' and actor is not null").groupBy("obs", "actor").agg(F.min("at").alias("said_at"))
    confirmers = once.join(said, "obs").where("said_at < cutoff").join(first, "obs", "left").where(~F.col("actor").eqNullSafe(F.col("owner"))).select("obs", "source", "outcome", "actor", F.lit(1).alias("confirmer"))
    owners = once.join(first, "obs").where("owner is not null").select("obs", "source", "outcome", F.col("owner").alias("actor"), F.lit(0).alias("confirmer"))
    gain = confirmers.unionByName(owners).groupBy("actor").agg(F.count_if(F.col("outcome") == "confirmed").alias("yes"), F.count_if(F.col("outcome") == "rejected").alias("no"), F.count_if((F.col("outcome") == "confirmed") & (F.col("confirmer") == 1)).alias("backed"))
    j = reporters.join(gain, "actor", "left").na.fill(0, ["yes", "no", "backed"])
    return j.select("actor", (F.col("alpha") + F.col("yes")).alias("alpha"), (F.col("beta") + F.col("no")).alias("beta"), (F.col("corroborated") + F.col("backed")).alias("corroborated"))


def cast_votes(votes: DataFrame, states: DataFrame) -> DataFrame:
    """The earliest vote of each subject, actor and type on subjects that aren't settled."""
    settled = states.where(F.col("state").isin(TERMINAL)).select("subject").distinct()
    first = votes.groupBy("subject", "actor", "type").agg(F.min(F.struct("at", "id")).alias("x")).select("subject", "actor", "type", "x.at", "x.id")
    return first.join(settled, "subject", "left_anti")


def rate_by_cell(reports: DataFrame, seconds: int = 60) -> DataFrame:
    """Accepted reports of the same actor, and of it in the same cell, in the (t - seconds, t] before each, itself left out."""
    span = -(seconds * 1_000_000 - 1)
    w = Window.partitionBy("actor", "period").orderBy(F.unix_micros("at")).rangeBetween(span, 0)
    c = Window.partitionBy("actor", "period", "cell").orderBy(F.unix_micros("at")).rangeBetween(span, 0)
    ok = F.col("accepted").cast("int")
    return in_periods(reports, seconds).withColumns({"recent": F.sum(ok).over(w) - ok, "recent_here": F.sum(ok).over(c) - ok}).where("own").drop("own", "period")


def page_beyond(rows: DataFrame, order: list[Column], cap: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``cap`` rows, one row telling whether there are more): one more is read than is kept."""
    got = rows.orderBy(*order).limit(cap + 1)
    return got.orderBy(*order).limit(cap), got.agg((F.count("*") > cap).alias("more"))


def oldest_first(rows: DataFrame, age: str, position: str, cap: int) -> DataFrame:
    """The ``cap`` rows that were served longest ago, never served ones before them, in order of position among equals."""
    return rows.orderBy(F.col(age).asc_nulls_first(), position).limit(cap)


def capped_by_source(rows: DataFrame, key: str, ordinal: str, cap: int = 100_000) -> DataFrame:
    """One row per source and key (the last of the ordinal, at the first's place), and of each source the first ``cap``."""
    rest = [c for c in rows.columns if c not in ("source", key, ordinal)]
    one = rows.groupBy("source", key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("x"), F.min(ordinal).alias(ordinal)).select("source", key, ordinal, *[F.col(f"x.{c}").alias(c) for c in rest])
    w = Window.partitionBy("source").orderBy(ordinal)
    return one.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Ledger ids that occur more than once in an observation's ledger: such a ledger is corrupt."""
    return rows.groupBy("obs", "id").agg(F.count("*").alias("n")).where("n > 1").select("obs", "id")
