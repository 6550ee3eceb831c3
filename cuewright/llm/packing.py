"""Filling fixed-capacity containers with items (problem 9).

Vector bin packing with the dot-product heuristic: an open container takes,
of the items that still fit under all limits (tokens, segments, loss-bearing
tokens), the one whose weighted demand has the greatest dot product with what
is left of the container. Items are spread over shards by a hash, each shard
packs on its own and so leaves at most a few containers partly filled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.tokens import TOKENIZER_FOLDER, VOCABULARY, Codec
from cuewright.runtime import col, require

#: Rows of a shard on average; it bounds what one task holds.
SHARD_ROWS = 10_000
#: A container of capacity c takes at most c / TOKENS_A_SEGMENT segments, at least LEAST_SEGMENTS.
TOKENS_A_SEGMENT, LEAST_SEGMENTS = 48, 4
#: Share of the capacity that loss-bearing tokens may fill; the rest is for context that isn't learnt.
LOSS_SHARE = 0.98

_ASIDE = re.compile(r"\[[^\[\]]*\]|\([^()]*\)")


def pack_vectors(demand: np.ndarray, limits: Sequence[float]) -> list[list[int]]:
    """Containers as lists of row numbers; every row of demand (items x limits) must fit alone.

    Items of equal demand form a class, so a step costs as much as there are
    different demands. Deterministic: equal products take the larger demand.
    """
    if not len(demand):
        return []
    limit = np.asarray(limits, dtype=np.float64)
    classes, inverse = np.unique(demand, axis=0, return_inverse=True)
    members: dict[int, list[int]] = defaultdict(list)
    for row, c in enumerate(inverse.ravel()):
        members[int(c)].append(row)
    sizes = classes / limit
    left = np.array([len(members[c]) for c in range(len(classes))])
    # Demand that is scarce in total weighs more.
    weight = (sizes * left[:, None]).sum(axis=0)
    weight = weight / weight.sum() if weight.sum() else np.ones(len(limit))
    out: list[list[int]] = []
    remaining = int(left.sum())
    order = np.arange(len(classes))
    while remaining:
        free = [1.0] * len(limit)
        now: list[int] = []
        live = order = order[left[order] > 0]
        columns = [sizes[live, j] for j in range(len(limit))]
        while True:
            fits = columns[0] <= free[0] + 1e-12
            for c, f in zip(columns[1:], free[1:]):
                fits &= c <= f + 1e-12
            if now:
                fits &= left[live] > 0
            if not fits.all():
                live = live[fits]
                columns = [c[fits] for c in columns]
            if not len(live):
                break
            score = columns[0] * (weight[0] * free[0])
            for c, w, f in zip(columns[1:], weight[1:], free[1:]):
                score = score + c * (w * f)
            at = len(score) - 1 - int(score[::-1].argmax())
            best = int(live[at])
            now.append(members[best].pop())
            left[best] -= 1
            free = [f - float(c[at]) for f, c in zip(free, columns)]
        out.append(now)
        remaining -= len(now)
    return out


def _aside_tokens(text: str, lengths: np.ndarray) -> int:
    """Tokens, by their lengths in bytes, that end inside a bracketed part of the text."""
    ends = None
    n = at = at_byte = 0
    for m in _ASIDE.finditer(text):
        if ends is None:
            ends = np.cumsum(lengths)
        first = at_byte + len(text[at : m.start()].encode())
        at, at_byte = m.end(), first + len(m[0].encode())
        n += int(np.searchsorted(ends, at_byte, "right") - np.searchsorted(ends, first, "right"))
    return n


def token_counts(df: DataFrame, keys: Sequence[str], text: str, folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """keys + (n_tokens, n_loss_tokens) of each text; null and empty ones have none.

    Loss-bearing are the tokens outside bracketed interruptions and stage
    directions, which a model should not learn to speak; a token counts where
    its last byte stands.
    """
    require(df, *keys, text)
    path = f"{folder}/{vocabulary}"
    ks = [f"k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{a} {df.schema[k].dataType.simpleString()}" for k, a in zip(keys, ks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            sizes, loss = [], []
            for t in batch.column(len(ks)).to_pylist():
                ids = codec.encode(t) if t else []
                sizes.append(len(ids))
                loss.append(len(ids) - _aside_tokens(t, codec.lengths[ids]) if ids else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ks)], pa.array(sizes, pa.int64()), pa.array(loss, pa.int64())], [*ks, "n_tokens", "n_loss_tokens"])

    rows = df.select(*[col(k).alias(a) for k, a in zip(keys, ks)], col(text).alias("t"))
    out = rows.mapInArrow(run, f"{kinds}, n_tokens bigint, n_loss_tokens bigint")
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "n_tokens", "n_loss_tokens")


def container_limits(capacity: int, max_segments: int | None = None, loss_share: float = LOSS_SHARE) -> tuple[int, int]:
    """Segments and loss-bearing tokens that a container of a capacity may hold beside its tokens."""
    return max_segments or max(LEAST_SEGMENTS, capacity // TOKENS_A_SEGMENT), max(1, int(loss_share * capacity))


def pack_summary(packed: DataFrame, key: str, max_segments: int | None = None, loss_share: float = LOSS_SHARE) -> DataFrame:
    """A row for each pack size: what its containers hold, which limits end them, and how many break one (none should).

    pack_id, capacity, n_keys, n_containers, n_tokens; n_at_segments and
    n_at_loss (no room left for one more segment or loss-bearing token while
    there is for tokens); n_over_tokens, n_over_segments, n_over_loss; and
    n_divided, the items cut though they fit the capacity.
    """
    most = F.lit(max_segments) if max_segments else F.greatest(F.lit(LEAST_SEGMENTS), F.floor(F.col("capacity") / TOKENS_A_SEGMENT))
    loss = F.greatest(F.lit(1), F.floor(F.lit(loss_share) * F.col("capacity")))
    each = packed.withColumn("_loss", F.least(F.col("n_loss_tokens"), loss)).groupBy("pack_id", "capacity", "shard", "container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("s"), F.sum("_loss").alias("l"))
    n = lambda when: F.count(F.when(when, 1))
    room = F.col("t") < F.col("capacity")
    held = each.groupBy("pack_id", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), n(room & (F.col("s") >= most)).alias("n_at_segments"), n(room & (F.col("l") >= loss)).alias("n_at_loss"),
        n(F.col("t") > F.col("capacity")).alias("n_over_tokens"), n(F.col("s") > most).alias("n_over_segments"), n(F.col("l") > loss).alias("n_over_loss"),
    )
    # An item's parts are counted by its key; what is cut has more than the capacity in all.
    items = packed.groupBy("pack_id", "capacity", col(key)).agg(F.max("part").alias("p"), F.sum("n_tokens").alias("t"))
    whole = items.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_keys"), n((F.col("p") > 0) & (F.col("t") <= F.col("capacity"))).alias("n_divided"))
    return held.join(whole, "pack_id")


def pack_items(items: DataFrame, key: str, tokens: str, loss_tokens: str, capacities: Sequence[tuple[int, int]], n_items: int | None = None, shard_rows: int = SHARD_ROWS, max_segments: int | None = None, loss_share: float = LOSS_SHARE) -> DataFrame:
    """pack_id, capacity, shard, container, key, part, start, n_tokens, n_loss_tokens: where every item goes.

    capacities: (pack_id, capacity) pairs. An item above the capacity is cut
    into parts, all but the last full; any other item has the one part 0.
    Items without tokens, or with null counts, take a segment and no room.
    Limits of a container: capacity tokens, max_segments segments, and
    loss_share x capacity loss-bearing tokens. An item that is above that limit
    alone isn't cut for it: it counts as the whole limit, so that only items
    without any join it. Rows with equal keys are items each.
    Items of one size, source or key may be as many as they like: shards come
    from a hash of the whole row and a spread over shard numbers.
    """
    require(items, key, tokens, loss_tokens)
    n = items.count() if n_items is None else n_items
    shards = max(1, -(-n // shard_rows))
    pairs = [(int(p), int(c)) for p, c in capacities if c and c > 0]
    kind = items.schema[key].dataType.simpleString()
    size = F.greatest(F.coalesce(col(tokens), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))
    loss = F.least(F.greatest(F.coalesce(col(loss_tokens), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint")), size)
    rows = items.select(col(key).alias("key"), size.alias("n"), loss.alias("loss"))
    target: Column = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in pairs])) if pairs else F.explode(F.expr("cast(array() as array<struct<pack_id:int,capacity:bigint>>)"))
    rows = rows.select("*", target.alias("p")).select("key", "n", "loss", "p.*")
    # Equal rows differ by the place their task gives them, so that copies of one item spread too.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "n", F.monotonically_increasing_id()), F.lit(shards).cast("bigint")).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        at: tuple | None = None
        names = ["pack_id", "capacity", "shard", "container", "key", "part", "start", "n_tokens", "n_loss_tokens"]
        key_type = None

        def flush() -> pa.RecordBatch | None:
            if not group:
                return None
            pack_id, capacity, shard = at  # type: ignore[misc]
            most, loss_limit = container_limits(capacity, max_segments, loss_share)
            parts: list[tuple] = []  # key, part, start, tokens, loss
            for k, n_row, loss_row in group:
                # Parts share the loss-bearing tokens by their size; their sum stays what it is.
                start = part = 0
                upto = lambda at: loss_row * at // n_row if n_row else 0  # noqa: E731, B023
                while n_row - start > capacity:
                    parts.append((k, part, start, capacity, upto(start + capacity) - upto(start)))
                    start, part = start + capacity, part + 1
                parts.append((k, part, start, n_row - start, loss_row - upto(start)))
            demand = np.array([(p[3], 1, min(p[4], loss_limit)) for p in parts], dtype=np.float64)
            rows_out = []
            for number, rows_in in enumerate(pack_vectors(demand, (capacity, most, loss_limit))):
                rows_out += [(pack_id, capacity, shard, number, *parts[r]) for r in rows_in]
            cols = list(zip(*rows_out))
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            key_type = batch.schema.field(3).type
            for pack_id, capacity, shard, k, n_row, loss_row in zip(*[c.to_pylist() for c in batch.columns]):
                if (pack_id, capacity, shard) != at:
                    done = flush()
                    if done is not None:
                        yield done
                    at, group = (pack_id, capacity, shard), []
                group.append((k, n_row, loss_row))
        done = flush()
        if done is not None:
            yield done

    spread = rows.select("pack_id", "capacity", "shard", "key", "n", "loss").repartition("pack_id", "shard").sortWithinPartitions("pack_id", "capacity", "shard", "n", "key")
    out = spread.mapInArrow(pack, f"pack_id int, capacity bigint, shard int, container int, key {kind}, part int, start bigint, n_tokens bigint, n_loss_tokens bigint")
    return out.withColumnRenamed("key", key)
