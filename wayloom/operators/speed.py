"""Speed history: sparse hourly histograms that merge, percentiles from them, baselines and weekly profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.scalars import bin_midpoint, dow0, plausible_speed, speed_bin


def raw_samples(flows: DataFrame, cadence_s: int = 60) -> DataFrame:
    """Plausible speeds, one per sensor and cadence bucket; of several the smallest (time, speed, source) stays."""
    ok = flows.where(plausible_speed(F.col("speed_kph"))).withColumn("bucket", F.floor(F.unix_seconds("observed_at") / cadence_s))
    first = F.min(F.struct("observed_at", "speed_kph", "source")).alias("x")
    return ok.groupBy("sensor_key", "bucket").agg(first).select("sensor_key", F.timestamp_seconds(F.col("bucket") * cadence_s).alias("observed_at"), "x.speed_kph", "x.source")


def bin_counts(samples: DataFrame) -> DataFrame:
    """(sensor_key, hour, bin, c, source): partial counts combine before the shuffle."""
    hour = F.timestamp_seconds(F.floor(F.unix_seconds("observed_at") / 3600) * 3600)
    return samples.groupBy("sensor_key", hour.alias("hour"), speed_bin(F.col("speed_kph")).alias("bin")).agg(F.count("*").alias("c"), F.min("source").alias("source"))


def hourly_histogram(samples: DataFrame) -> DataFrame:
    """One row per sensor and hour, with bins and counts as parallel arrays in order of the bin (128 entries at most)."""
    entry = F.array_sort(F.collect_list(F.struct("bin", "c")))
    h = bin_counts(samples).groupBy("sensor_key", "hour").agg(F.sum("c").alias("sample_count"), F.min("source").alias("source"), entry.alias("e"))
    return h.select("sensor_key", "hour", "source", "sample_count", F.col("e.bin").alias("speed_bins"), F.col("e.c").alias("speed_counts"))


def unnested(histogram: DataFrame) -> DataFrame:
    """(…, bin, c) from the parallel arrays."""
    keep = [c for c in histogram.columns if c not in ("speed_bins", "speed_counts")]
    z = histogram.select(*keep, F.explode(F.arrays_zip("speed_bins", "speed_counts")).alias("z"))
    return z.select(*keep, F.col("z.speed_bins").alias("bin"), F.col("z.speed_counts").alias("c"))


def histogram_percentile(bins: DataFrame, keys: list[str], fraction: str, name: str, min_samples: int) -> DataFrame:
    """Midpoint of the first bin whose running count reaches fraction * total, for keys with enough samples. fraction: a decimal literal."""
    merged = bins.groupBy(*keys, "bin").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys)
    run = merged.withColumns({"cum": F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("c").over(w)})
    out = run.groupBy(*keys).agg(F.min(F.when(F.expr(f"cum >= {fraction} * total"), F.col("bin"))).alias("b"), F.max("total").alias("sample_count"))
    return out.where(F.col("sample_count") >= min_samples).select(*keys, bin_midpoint(F.col("b")).alias(name), "sample_count")


def baselines(bins: DataFrame, min_samples: int = 30) -> DataFrame:
    """p85 per (sensor, weekend, UTC hour) and overall (-1, -1), from one pass over grouping sets."""
    b = bins.withColumns({"dow_bucket": dow0(F.col("hour")).isin(0, 6).cast("int"), "tod_bucket": F.hour("hour")})
    sets = b.groupingSets([["sensor_key", "bin", "dow_bucket", "tod_bucket"], ["sensor_key", "bin"]], "sensor_key", "bin", "dow_bucket", "tod_bucket").agg(F.sum("c").alias("c"))
    sets = sets.withColumns({"dow_bucket": F.coalesce("dow_bucket", F.lit(-1)), "tod_bucket": F.coalesce("tod_bucket", F.lit(-1))})
    return histogram_percentile(sets, ["sensor_key", "dow_bucket", "tod_bucket"], "0.85", "free_flow_kph", min_samples).withColumn("method", F.lit("derived"))


def pick_baseline(rows: DataFrame) -> DataFrame:
    """Overall rows: native before derived before osm_maxspeed."""
    rank = F.when(F.col("method") == "native", 0).when(F.col("method") == "derived", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), "method", "free_flow_kph")).alias("x")
    return rows.where("dow_bucket = -1 and tod_bucket = -1").groupBy("sensor_key").agg(best).select("sensor_key", "x.method", "x.free_flow_kph")


def weekly_profile(bins: DataFrame, key: str, tz: str, min_samples: int = 20) -> DataFrame:
    """Median per (key, local day of week, local hour)."""
    local = F.from_utc_timestamp("hour", tz)
    b = bins.withColumns({"dow": dow0(local), "tod_hour": F.hour(local)})
    return histogram_percentile(b, [key, "dow", "tod_hour"], "0.5", "median_kph", min_samples)


def week_array(profile: DataFrame, key: str) -> DataFrame:
    """168 slots (dow * 24 + hour), null where there is no bucket."""
    slots = F.map_from_entries(F.collect_list(F.struct((F.col("dow") * 24 + F.col("tod_hour")).alias("k"), "median_kph")))
    return profile.groupBy(key).agg(slots.alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(167)), lambda i: F.try_element_at("m", i)).alias("week"))


def daytime_median(profile: DataFrame, key: str, first: int = 7, last: int = 19) -> DataFrame:
    return profile.where(F.col("tod_hour").between(first, last)).groupBy(key).agg(F.median("median_kph").alias("daytime_kph"))


def rollup_range(now: Column, watermark: Column, lookback_h: int = 6, floor_d: int = 35) -> tuple[Column, Column]:
    """[from, to) of hours to roll up again: lookback before the watermark, not before the floor, up to the open hour."""
    open_hour = F.date_trunc("hour", now)
    floor = open_hour - F.expr(f"interval {floor_d} days")
    return F.greatest(F.coalesce(watermark - F.expr(f"interval {lookback_h} hours"), floor), floor), open_hour


def prunable(samples: DataFrame, histogram: DataFrame, now: Column, keep_d: int = 2, floor_d: int = 35) -> DataFrame:
    """Raw rows that may go: old enough with a rolled-up bucket of their own, or beyond the floor."""
    s = samples.withColumn("hour", F.timestamp_seconds(F.floor(F.unix_seconds("observed_at") / 3600) * 3600))
    done = histogram.select("sensor_key", "hour").distinct().withColumn("rolled", F.lit(True))
    old = F.col("observed_at") < now - F.expr(f"interval {keep_d} days")
    return s.join(done, ["sensor_key", "hour"], "left").where((old & F.col("rolled")) | (F.col("observed_at") < now - F.expr(f"interval {floor_d} days"))).drop("rolled", "hour")
