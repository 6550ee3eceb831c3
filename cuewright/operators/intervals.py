"""Continuous periods and gaps of overlapping time intervals (problem 4).

Two-level merge. Intervals are clipped into time shards of a fixed width and
merged inside each shard; only the coverage that touches a shard boundary goes
to a second merge per entity, which sees a few rows per shard and not one per
interval. An entity with a third of all rows is therefore spread over as many
tasks as it has shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.runtime import col, require, settle_table

SHARD_MS = 600_000
NO_GAP_FROM_MS = 6 * 3600 * 1000


def _islands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge overlapping or touching [lo, hi) rows within keys."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("lo") > before)).cast("int")
    numbered = df.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def covered_periods(df: DataFrame, keys: Sequence[str], start: str, end: str, shard_ms: int = SHARD_MS) -> DataFrame:
    """Longest stretches covered by intervals of one entity.

    Returns keys + (start_ms, end_ms). A row counts if both times are present
    and end > start; others, and so an empty table, give nothing. Intervals
    that touch merge. A null key is an entity of its own. Repeated rows change
    nothing. Other columns of df, whatever their names, are not looked at.
    """
    require(df, *keys, start, end)
    ks = [f"_k{i}" for i in range(len(keys))]
    spans = df.select(*[col(k).alias(a) for k, a in zip(keys, ks)], col(start).cast("long").alias("lo"), col(end).cast("long").alias("hi")).where("lo is not null and hi is not null and hi > lo")

    def shard(x: Column) -> Column:
        return F.floor(x / F.lit(shard_ms)).cast("long")

    width = F.lit(shard_ms)
    spans = spans.withColumn("_a", shard(F.col("lo"))).withColumn("_b", shard(F.col("hi") - 1))
    piece = lambda sh, lo, hi, long: F.struct(sh.alias("shard"), lo.alias("lo"), hi.alias("hi"), F.lit(long).alias("long"))
    a, b, lo, hi = (F.col(c) for c in ("_a", "_b", "lo", "hi"))
    clipped = (
        F.when(a == b, F.array(piece(a, lo, hi, False)))
        .when(b == a + 1, F.array(piece(a, lo, b * width, False), piece(b, b * width, hi, False)))
        .otherwise(F.array(piece(a, lo, (a + 1) * width, False), piece(a + 1, (a + 1) * width, b * width, True), piece(b, b * width, hi, False)))
    )
    pieces = spans.select(*ks, F.explode(clipped).alias("p")).select(*ks, "p.*")
    # Before the shuffle: at most one row for each start in a shard.
    pieces = pieces.groupBy(*ks, "shard", "long", "lo").agg(F.max("hi").alias("hi"))
    local = _islands(pieces.where("not long").select(*ks, "shard", "lo", "hi"), [*ks, "shard"])
    edge = (F.col("lo") == F.col("shard") * width) | (F.col("hi") == (F.col("shard") + 1) * width)
    # Written once: four consumers read it.
    local = local.select(*ks, "shard", "lo", "hi", edge.alias("_edge"), F.lit(False).alias("long"))
    local = settle_table(local.unionByName(pieces.where("long").select(*ks, "shard", "lo", "hi", F.lit(True).alias("_edge"), "long")), "coverage")
    inner = local.where("not _edge").select(*ks, "shard", "lo", "hi")

    # Second level: coverage at boundaries, whole shards, and a mark for each shard that has inner pieces.
    touching = local.where("_edge and not long").select(*ks, "lo", "hi", F.lit(None).cast("long").alias("mark"))
    whole = local.where("long").select(*ks, "lo", "hi", F.lit(None).cast("long").alias("mark"))
    marks = inner.groupBy(*ks, "shard").agg(F.lit(1).alias("_n")).select(*ks, (F.col("shard") * width).alias("lo"), F.lit(None).cast("long").alias("hi"), F.col("shard").alias("mark"))
    w = Window.partitionBy(*ks).orderBy(F.col("lo"), F.col("mark").asc_nulls_first(), F.col("hi"))
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    second = touching.unionByName(whole).unionByName(marks)
    second = second.withColumn("_before", before).withColumn("_opens", (F.col("mark").isNull() & (F.col("_before").isNull() | (F.col("lo") > F.col("_before")))).cast("int"))
    second = second.withColumn("_island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = second.where("mark is null").groupBy(*ks, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")
    hidden = second.where(F.col("mark").isNotNull() & (F.col("_before") >= (F.col("mark") + 1) * width)).select(*ks, F.col("mark").alias("shard"))
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"h.{k}")) for k in ks] + [F.col("i.shard") == F.col("h.shard")]
    shown = inner.alias("i").join(hidden.alias("h"), same, "left_anti").select(*ks, "lo", "hi")
    both = shown.unionByName(stitched)
    return both.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"))


def gaps_between(periods: DataFrame, keys: Sequence[str], shard_ms: int = SHARD_MS, no_gap_from_ms: int | None = NO_GAP_FROM_MS) -> DataFrame:
    """Stretches between one period of an entity and the next.

    periods: disjoint, non-touching rows of keys + (start_ms, end_ms). Each
    period finds its successor inside its shard; the last of a shard takes the
    first of the next shard that has any. A stretch of no_gap_from_ms or more
    is left out (None: none is). One period, or none, gives no row.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    own = periods.select(*[col(k).alias(a) for k, a in zip(keys, ks)], "start_ms", "end_ms").withColumn("shard", F.floor(F.col("start_ms") / F.lit(shard_ms)).cast("long"))
    inside = own.withColumn("_next", F.lead("start_ms").over(Window.partitionBy(*ks, "shard").orderBy("start_ms")))
    within = inside.where("_next is not null").select(*ks, F.col("end_ms").alias("start_ms"), F.col("_next").alias("end_ms"))
    ends = own.groupBy(*ks, "shard").agg(F.min("start_ms").alias("first"), F.max("end_ms").alias("last"))
    across = ends.withColumn("_next", F.lead("first").over(Window.partitionBy(*ks).orderBy("shard"))).where("_next is not null")
    across = across.select(*ks, F.col("last").alias("start_ms"), F.col("_next").alias("end_ms"))
    gaps = within.unionByName(across)
    if no_gap_from_ms is not None:
        gaps = gaps.where(F.col("end_ms") - F.col("start_ms") < no_gap_from_ms)
    return gaps.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "start_ms", "end_ms")


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, shard_ms: int = SHARD_MS, no_gap_from_ms: int | None = NO_GAP_FROM_MS) -> DataFrame:
    """keys + (kind, start_ms, end_ms); kind is 'period' or 'gap'."""
    periods = settle_table(covered_periods(df, keys, start, end, shard_ms), "periods")
    gaps = gaps_between(periods, keys, shard_ms, no_gap_from_ms)
    return periods.select(*[col(k) for k in keys], F.lit("period").alias("kind"), "start_ms", "end_ms").unionByName(gaps.select(*[col(k) for k in keys], F.lit("gap").alias("kind"), "start_ms", "end_ms"))
