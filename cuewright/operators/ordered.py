"""Order-dependent results over huge groups, in two levels.

A window over one entity runs in one task, however large the entity. Here an
entity is cut into chunks of consecutive order numbers; windows run inside
chunks, totals of chunks are carried over in a second step that sees one row
a chunk, and the two are put together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.runtime import settle

#: Order numbers of a chunk where they are consecutive.
CHUNK = 65_536
#: Where they are places in a file: about what one task reads of it.
FILE_CHUNK = 64 << 20


def carried(df: DataFrame, keys: Sequence[str], order: str, wanted: Mapping[str, tuple[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """df with a column for each wanted name: a fold over the rows before, by order within keys.

    wanted: name -> (kind, value); kinds are count (of rows; value is unused),
    sum, max, min and last (non-null value). The row itself is not in its own
    fold. Without rows before a count or sum is 0, others are null. order is an
    integer column, unique within keys; keys are never null. chunk is the width
    of a chunk in order numbers: FILE_CHUNK for the block_seq of files, which are
    byte offsets.
    """
    piece = "_chunk"
    rows = df.withColumn(piece, F.floor(F.col(order) / F.lit(chunk)).cast("long"))
    inside = Window.partitionBy(*keys, piece).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    aggs, outer, joined = [], [], []
    for i, (name, (kind, value)) in enumerate(wanted.items()):
        rows = rows.withColumn(f"_v{i}", value if kind != "count" else F.lit(1).cast("long"))
        v, t, p = F.col(f"_v{i}"), f"_t{i}", f"_p{i}"
        total = {"count": F.sum(v), "sum": F.sum(v), "max": F.max(v), "min": F.min(v), "last": F.max_by(v, F.when(v.isNotNull(), F.col(order)))}[kind]
        aggs.append(total.alias(t))
        fold = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
        outer.append(fold(F.col(t)).over(across).alias(p))
        rows = rows.withColumn(f"_i{i}", fold(v).over(inside))
        here, before = F.col(f"_i{i}"), F.col(p)
        if kind in ("count", "sum"):
            joined.append((F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))).alias(name))
        elif kind == "last":
            joined.append(F.coalesce(here, before).alias(name))
        else:
            joined.append({"max": F.greatest, "min": F.least}[kind](here, before).alias(name))
    totals = rows.groupBy(*keys, piece).agg(*aggs)
    before = totals.select(*keys, piece, *outer)
    return rows.join(before, [*keys, piece]).select(*df.columns, *joined)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with 1-based numbers within keys by any sortable columns, however few keys there are.

    The rows are spread by ranges of keys and order; each range numbers its own
    rows, and counts are carried over the ranges. df is written out once, since
    ranges must not change between the two steps.
    """
    place = "_place"
    spread = settle(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(place, F.monotonically_increasing_id()))
    # The upper bits of these ids are the range's number.
    return carried(spread, keys, place, {name: ("count", F.lit(1))}, chunk=1 << 33).withColumn(name, F.col(name) + 1).drop(place)
