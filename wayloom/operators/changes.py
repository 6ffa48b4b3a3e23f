"""Snapshots and change: diffs, journals, sweeps, status, retention."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(columns: list[str]) -> Column:
    """Hash of named columns in order of their names; nulls are written."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def sorted_json(text: Column) -> Column:
    """JSON with the keys of all its objects in order and fields of null left out; null for what is no JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def bare(v):
            if isinstance(v, dict):
                return {k: bare(x) for k, x in sorted(v.items()) if x is not None}
            return [bare(x) for x in v] if isinstance(v, list) else v

        out = []
        for t in texts:
            try:
                out.append(None if t is None else json.dumps(bare(json.loads(t)), separators=(",", ":"), ensure_ascii=False))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)


def prune_batch(rows: DataFrame, at: str, key: str, size: int) -> DataFrame:
    """The oldest rows, at most ``size`` of them."""
    return rows.orderBy(at, key).limit(size)


def projected(rows: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """Stored rows with fields of their JSON ``attributes`` spread to columns (name: type) where the row has no column of that name."""
    return rows.select("*", *[F.get_json_object("attributes", f"$.{k}").cast(t).alias(k) for k, t in attributes.items() if k not in rows.columns]).drop("attributes")


def stored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The reverse: the named columns as they are, all others as one JSON text ``attributes``, nulls left out."""
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*columns, F.to_json(F.struct(*rest)).alias("attributes"))


def last_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key: the values of its last, the position of its first."""
    rest = [c for c in rows.columns if c not in (key, ordinal)]
    got = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("x"), F.min(ordinal).alias(ordinal))
    return got.select(key, ordinal, *[F.col(f"x.{c}").alias(c) for c in rest])


def diff(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, change, old_*, new_*): inserted, updated, deleted or unchanged by null-safe comparison. One shuffle of both sides on the key."""
    a = old.select(F.col(key).alias("ka"), *[F.col(c).alias(f"old_{c}") for c in compare])
    b = new.select(F.col(key).alias("kb"), *[F.col(c).alias(f"new_{c}") for c in compare])
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("ka").isNull(), "inserted").when(F.col("kb").isNull(), "deleted").when(same, "unchanged").otherwise("updated")
    return a.join(b, a.ka == b.kb, "full").withColumn("change", change).withColumn(key, F.coalesce("ka", "kb")).drop("ka", "kb")


def apply_diff(old: DataFrame, changes: DataFrame, key: str, compare: list[str]) -> DataFrame:
    kept = changes.where("change <> 'deleted'")
    return kept.select(key, *[F.col(f"new_{c}").alias(c) for c in compare])


def outbox(changes: DataFrame, has_subscriber: bool, archived: Column) -> DataFrame:
    """Journal rows of a diff: create, update or delete (an archived row too); nothing without a subscriber."""
    op = F.when((F.col("change") == "deleted") | ((F.col("change") == "updated") & archived), "delete").when(F.col("change") == "inserted", "create").otherwise("update")
    return changes.where((F.col("change") != "unchanged") & F.lit(has_subscriber)).withColumn("operation", op)


def guard_swap(old_rows: int, new_rows: int, is_flow: bool, failed: int, fetched: int, least_share: float = 0.5) -> str | None:
    """Why a swap must not happen, or None."""
    if is_flow and new_rows == 0:
        return "empty flow"
    if fetched and failed / fetched > least_share:
        return "too many parts failed"
    if old_rows and new_rows < least_share * old_rows:
        return "shrank too far"
    return None


def merge_status(prev: DataFrame, polls: DataFrame) -> DataFrame:
    """Per source the last attempt and success; a poll without a count keeps the earlier count."""
    u = prev.select("source", "at", "ok", "row_count").unionByName(polls.select("source", "at", "ok", "row_count"))
    return u.groupBy("source").agg(F.max("at").alias("last_attempt"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"), F.max_by(F.when(F.col("row_count").isNotNull(), F.col("row_count")), F.when(F.col("row_count").isNotNull(), F.col("at"))).alias("row_count"))


def sweepable(obs: DataFrame, status: DataFrame, now: Column, max_age_h: int) -> DataFrame:
    """Rows to drop: expired, past their end, or of a feed without a success within the age. Crowd rows have no status and stay."""
    recent = status.where(F.col("last_success") >= now - F.expr(f"interval {max_age_h} hours")).select("source").distinct().withColumn("fresh", F.lit(True))
    j = obs.join(recent, "source", "left")
    gone = (F.col("expires_at") <= now) | (F.col("valid_to") <= now) | ((F.col("origin_kind") == "feed") & F.col("fresh").isNull())
    return j.where(F.coalesce(gone, F.lit(False))).drop("fresh")


def supersede(obs: DataFrame) -> DataFrame:
    """Ids that another row of the same instance replaces."""
    named = obs.select(F.explode("replaces").alias("id"), "instance")
    return obs.join(named.distinct(), ["id", "instance"], "left_semi").select("id")


def retained(journal: DataFrame, now: Column, requested_d: int, floor_d: int = 37) -> DataFrame:
    return journal.where(F.col("created_at") >= now - F.expr(f"interval {max(requested_d, floor_d)} days"))


def beyond_window(journal: DataFrame, cursor_at: Column, now: Column, days: int = 30) -> DataFrame:
    """Rows of the backfill window after the cursor, and whether the cursor lies beyond it."""
    start = now - F.expr(f"interval {days} days")
    return journal.where(F.col("created_at") >= F.greatest(cursor_at, start)).withColumn("beyond_window", cursor_at < start)


def numbered(journal: DataFrame, by: list[str]) -> DataFrame:
    """A sequence within each partition key of the journal (the first of ``by``)."""
    return journal.withColumn("seq", F.row_number().over(Window.partitionBy(by[0]).orderBy(*by[1:])))
