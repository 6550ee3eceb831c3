"""Differences between two copies of a table (problem 7).

A column-by-bucket checksum matrix: keys fall into hash buckets, and for each
bucket every column has an additive 128-bit hash over (key, value). Only the
buckets whose checksums differ are read again and joined, and in them only
the columns that differ are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.runtime import col, require, settle

KEYS_A_BUCKET = 8
MIN_BUCKETS = 1024
MAX_BUCKETS = 1 << 26
#: Unequal cells are broadcast up to this many (a few MB); beyond it they are joined by shuffle.
BROADCAST_CELLS = 100_000


def _tagged(c: Column) -> list[Column]:
    return [c.isNull(), c]


def bucket_of(keys: Sequence[Column], n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), *[x for k in keys for x in _tagged(k)]), F.lit(n_buckets).cast("long"))


def _normal(df: DataFrame, keys: Sequence[str], fields: Sequence[str], version: str | None, n_buckets: int) -> DataFrame:
    require(df, *keys, *fields, *([version] if version else []))
    chosen = [col(k).alias(f"k{i}") for i, k in enumerate(keys)] + [col(f).alias(f"f{i}") for i, f in enumerate(fields)]
    out = df.select(*chosen, (col(version) if version else F.lit(0)).alias("v"))
    return out.withColumn("bucket", bucket_of([F.col(f"k{i}") for i in range(len(keys))], n_buckets))


def _latest(df: DataFrame, n_keys: int, n_fields: int) -> DataFrame:
    """One row of each key: the greatest version; among equals the greatest values, nulls lowest."""
    ks = ["bucket", *[f"k{i}" for i in range(n_keys)]]
    best = F.max(F.struct("v", *[f"f{i}" for i in range(n_fields)])).alias("best")
    return df.groupBy(*ks).agg(best).select(*ks, *[F.col(f"best.f{i}").alias(f"f{i}") for i in range(n_fields)])


def _matrix(latest: DataFrame, n_keys: int, n_fields: int, side: str) -> DataFrame:
    ks = [x for i in range(n_keys) for x in _tagged(F.col(f"k{i}"))]
    sums = []
    for name in ["key", *[f"f{i}" for i in range(n_fields)]]:
        value = [] if name == "key" else _tagged(F.col(name))
        for seed in (1, 2):
            h = F.xxhash64(F.lit(seed), *ks, *value)
            # Halves of 32 bits: their sums can't overflow below 2^31 keys a bucket.
            sums += [F.sum(F.shiftright(h, 32)).alias(f"{side}_{name}_{seed}h"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{side}_{name}_{seed}l")]
    return latest.groupBy("bucket").agg(*sums)


def unequal_cells(primary: DataFrame, replica: DataFrame, keys: Sequence[str], fields: Sequence[str], version: str | None, n_buckets: int) -> DataFrame:
    """(bucket, key, f0, f1, ...): the buckets that differ, and per column whether it differs there."""
    nk, nf = len(keys), len(fields)
    a = _matrix(_latest(_normal(primary, keys, fields, version, n_buckets), nk, nf), nk, nf, "a")
    b = _matrix(_latest(_normal(replica, keys, fields, version, n_buckets), nk, nf), nk, nf, "b")
    both = a.join(b, "bucket", "full_outer")

    def differs(name: str) -> Column:
        parts = [~F.col(f"a_{name}_{s}").eqNullSafe(F.col(f"b_{name}_{s}")) for s in ("1h", "1l", "2h", "2l")]
        return parts[0] | parts[1] | parts[2] | parts[3]

    names = ["key", *[f"f{i}" for i in range(nf)]]
    flags = both.select("bucket", *[differs(n).alias(n) for n in names])
    some = F.lit(False)
    for n in names:
        some = some | F.col(n)
    return flags.where(some)


def replica_differences(primary: DataFrame, replica: DataFrame, keys: Sequence[str], fields: Sequence[str], version: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """keys + (diff, primary_value, replica_value), one row for each difference.

    diff is 'missing_in_replica', 'missing_in_primary' (values null), or the
    name of a field whose values differ (given as strings). Of several rows of
    a key in a copy the one with the greatest version counts (null is lowest;
    ties take the greatest values, so the choice doesn't hang on row order).
    Nulls: a null value equals only null, and a null key only a null key.
    Empty copies: every key of the other is missing. Extra columns are ignored.
    n_buckets: by default one bucket for KEYS_A_BUCKET rows of the larger copy.
    """
    if n_buckets is None:
        rows = max(primary.count(), replica.count())  # from the parquet footers
        n_buckets = MIN_BUCKETS
        while n_buckets * KEYS_A_BUCKET < rows and n_buckets < MAX_BUCKETS:
            n_buckets *= 2
    nk, nf = len(keys), len(fields)
    cells = settle(unequal_cells(primary, replica, keys, fields, version, n_buckets))
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    buckets = cells.select("bucket")

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = _normal(df, keys, fields, version, n_buckets).join(buckets, "bucket", "left_semi")
        out = _latest(rows, nk, nf)
        return out.select("bucket", *[F.col(f"k{i}").alias(f"{name}_k{i}") for i in range(nk)], *[F.col(f"f{i}").alias(f"{name}_f{i}") for i in range(nf)], F.lit(True).alias(f"{name}_here")).withColumnRenamed("bucket", f"{name}_bucket")

    a, b = side(primary, "a"), side(replica, "b")
    on = [F.col("a_bucket") == F.col("b_bucket")] + [F.col(f"a_k{i}").eqNullSafe(F.col(f"b_k{i}")) for i in range(nk)]
    both = a.join(b, on, "full_outer").withColumn("bucket", F.coalesce("a_bucket", "b_bucket"))
    both = both.join(cells, "bucket")
    nothing = F.lit(None).cast("string")
    rows = [F.when(F.col("b_here").isNull(), F.struct(F.lit("missing_in_replica").alias("diff"), nothing.alias("primary_value"), nothing.alias("replica_value")))]
    rows.append(F.when(F.col("a_here").isNull(), F.struct(F.lit("missing_in_primary").alias("diff"), nothing.alias("primary_value"), nothing.alias("replica_value"))))
    for i, f in enumerate(fields):
        x, y = F.col(f"a_f{i}"), F.col(f"b_f{i}")
        here = F.col("a_here") & F.col("b_here") & F.col(f"f{i}") & ~x.eqNullSafe(y)
        rows.append(F.when(here, F.struct(F.lit(f).alias("diff"), x.cast("string").alias("primary_value"), y.cast("string").alias("replica_value"))))
    found = both.select(*[F.when(F.col("a_here"), F.col(f"a_k{i}")).otherwise(F.col(f"b_k{i}")).alias(k) for i, k in enumerate(keys)], F.explode(F.array(*rows)).alias("d"))
    return found.where("d is not null").select(*[col(k) for k in keys], "d.diff", "d.primary_value", "d.replica_value")
