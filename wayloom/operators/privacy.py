"""Bounded shaping before a private release: clamping, one tuple a cell, bounded cells a unit, a public grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_windows(tuples: DataFrame, windows: DataFrame, slot_ms: int = 86_400_000) -> DataFrame:
    """Tuples with the half-open window they fall in. The manifest's windows may not overlap; both sides meet in slots of a day."""
    slots = windows.where("end_ms > start_ms").withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_ms") / slot_ms), F.floor((F.col("end_ms") - 1) / slot_ms))))
    own = tuples.withColumn("slot", F.floor(F.col("ts_ms") / slot_ms))
    return own.join(slots, "slot").where((F.col("ts_ms") >= F.col("start_ms")) & (F.col("ts_ms") < F.col("end_ms"))).drop("slot")


def shaped(tuples: DataFrame, low: float, high: float, max_cells: int) -> DataFrame:
    """(unit, cell, speed): the lowest clamped speed of each unit and cell, and of each unit its first cells."""
    clamp = F.least(F.greatest(F.col("speed"), F.lit(low)), F.lit(high))
    one = tuples.groupBy("unit", "cell").agg(F.min(clamp).alias("speed"))
    w = Window.partitionBy("unit").orderBy("cell")
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_cells).drop("r")


def release(shaped_rows: DataFrame, grid: DataFrame, noise: Callable[[Column], Column] | None = None, least_units: int = 0) -> DataFrame:
    """Sum and count for every cell of the public grid, empty ones too; noise is the caller's mechanism."""
    g = shaped_rows.groupBy("cell").agg(F.sum("speed").alias("total"), F.count("*").alias("units"))
    out = grid.join(g, "cell", "left").select("cell", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("units", F.lit(0)).alias("units"))
    out = out.withColumns({"total": noise(F.col("total")), "units": noise(F.col("units"))}) if noise else out
    return out.withColumn("released", F.col("units") >= least_units)
