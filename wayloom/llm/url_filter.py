"""URL rules by a sort-merge range join.

A host read from its last label to its first, each label followed by a slash
(which no host holds), is a key under which a host and its subdomains form one interval. Urls and
rules are cut into ranges of keys, each range is sorted, and one sweep over it
keeps a stack of the rules whose interval is open; rules nest as their hosts
do. Of the open rules whose path starts the url's path the longest wins (host
and path together, the longer host if equal).

A rule's interval may reach over several ranges and is sent to each of them;
a host with very many urls is cut by a hash of the row, so it fills several ranges.

Cases: a null url or one without ``://`` has an empty host and path, no rule,
and the default verdict; without a fitting rule the verdict is the default,
``allow`` (a filter drops only what a rule blocks); of rules with equal host and
path and different verdicts the smaller word counts (allow before block); rules
with an empty host or a null fit nothing. Rows may repeat; null page_ids stay; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import shuffle_partitions

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: About so many keys are looked at for the cuts between ranges, however long the table; they balance work and change no result.
CUT_SAMPLE = 4000


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/")))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as the table that ``filter_urls`` takes."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    host, path = host_path(F.col("u"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("tie", F.xxhash64("page_id", "path"))
    n = shuffle_partitions(spark)
    share = min(1.0, CUT_SAMPLE / max(1, pages.count()))
    picked = urls.where(F.pmod(F.xxhash64("key", "tie", F.lit(7)), F.lit(1 << 40)) < int(share * (1 << 40))).select("key", "tie").limit(4 * CUT_SAMPLE).collect()
    picked = sorted((r.key, r.tie) for r in picked)
    cuts = sorted({picked[len(picked) * i // n] for i in range(1, n)}) if picked else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((bisect_right(cuts, x) for x in zip(key, tie)), np.int32, len(key)))

    lowest = F.lit(-(2**63))
    end = F.expr("concat(substring(key, 1, length(key) - 1), '0')")  # the first key beyond all that start as a rule's: 0 follows the slash
    own = rules.select("verdict", F.translate("host", ASCII_UPPER, ASCII_LOWER).alias("host"), "path").where("host <> '' and verdict is not null and path is not null")
    own = own.withColumn("key", host_key(F.col("host")))
    own = own.withColumn("p", F.explode(F.sequence(range_of("key", lowest), range_of(end, lowest))))
    kinds = "p int, key string, kind int, page_id long, host string, path string, verdict string"
    both = own.select("p", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict").union(
        urls.select(range_of("key", "tie").alias("p"), "key", F.lit(1), F.col("page_id").cast("long"), "host", "path", F.lit(None).cast("string"))
    )

    def sweep(batches):
        at, stack = None, []  # of (key, [(length, host length, path, rule, verdict), longest first])
        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            out: list[list] = [[], [], [], [], []]
            for p, key, kind, page_id, host, path, verdict in zip(*(col[c.split()[0]] for c in kinds.split(", "))):
                if p != at:
                    at, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((len(host) + len(path), len(host), path, host + path, verdict))
                    stack[-1][1].sort(key=lambda r: (-r[0], -r[1], r[3], r[4]))
                    continue
                best = None
                for _, held in stack:
                    hit = next((r for r in held if path.startswith(r[2])), None)
                    if hit and (best is None or hit[:2] > best[:2]):
                        best = hit
                for c, v in zip(out, (page_id, host, path, best[3] if best else None, best[4] if best else default)):
                    c.append(v)
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(out[0], pa.int64())} | {c: pa.array(v, pa.string()) for c, v in zip(("host", "path", "rule", "verdict"), out[1:])})

    swept = both.repartition(n, "p").sortWithinPartitions("p", "key", "kind")
    return swept.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
