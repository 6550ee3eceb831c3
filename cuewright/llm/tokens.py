"""Encoding of a corpus with a public tokenizer (problem 8).

Content-defined chunk reuse: a rolling hash over the characters cuts every
text into chunks; equal chunks of different documents are encoded once, and
the documents are put together from the encoded chunks. A cut is moved to the
next place where the tokenizer's splitting pattern always has a boundary;
where there is none near, the join is repaired: text around it is split and
encoded again until the boundaries agree with those of the next chunk.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.runtime import col, require, settle_table

TOKENIZER_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary's splitting pattern (fixed value, as its publisher gives it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters under the rolling hash, mean distance of cuts, least and greatest length of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 256, 64, 4096
#: Characters hashed at once.
AT_ONCE = 1 << 19
#: How far a cut may move to a sure boundary.
REACH = 128
#: Chunks with this share of all occurrences or more are broadcast: at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001

#: White space and controls by code point; all above the table is neither.
_BLANK = np.zeros(0x3002, dtype=bool)
_BLANK[[*range(0x21), *range(0x7F, 0xA1), 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_kept_powers: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each."""
    if not _kept_powers or len(_kept_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for x in (_BASE, _INVERSE):
            steps = np.full(size, x, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _kept_powers[:] = made
    return _kept_powers[0][:n], _kept_powers[1][:n]


def rolling_hash(points: np.ndarray) -> np.ndarray:
    """At each place the sum of (point + 1) x base^age over the last WINDOW points, modulo 2^64.

    It is a difference of two prefix sums, scaled back, so it costs the same
    for any window and hangs on the window's points alone.
    """
    up, down = _powers(len(points))
    sums = np.cumsum((points.astype(np.uint64) + np.uint64(1)) * down, dtype=np.uint64)
    h = sums.copy()
    h[WINDOW:] -= sums[:-WINDOW]
    return h * up


def _width(n_ids: int) -> np.dtype:
    """How ids travel between stages: two bytes each where the vocabulary allows it."""
    return np.dtype("<u2") if n_ids <= 1 << 16 else np.dtype("<u4")


class Codec:
    """A byte-level BPE vocabulary; one is kept for each file and worker."""

    _kept: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.width = _width(max(ranks.values(), default=0) + 1)
        #: Bytes of each token.
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        self.lengths[list(ranks.values())] = [len(x) for x in ranks]

    def packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=self.width).tobytes()

    def unpacked(self, data: bytes) -> list[int]:
        return np.frombuffer(data, dtype=self.width).tolist()

    @classmethod
    def of(cls, path: str, pattern: str = PATTERN) -> Codec:
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        one = self.encoding.encode_ordinary
        return [one(t) for t in texts]

    def text(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of text(left) + text(right), re-encoding only around the join.

        Splitting goes from left to right and looks one character ahead, so of
        the left part all but its last two pieces stand; from there the joint
        text is split again until a boundary is also one of the right part.
        """
        a, b = self.text(left), self.text(right)
        starts = [m.start() for m in self.pattern.finditer(a)]
        from_ = starts[-2] if len(starts) > 1 else 0
        bounds = {m.start() for m in self.pattern.finditer(b) if m.start()} | {len(b)}
        joint = a[from_:] + b
        shift = len(a) - from_
        pieces: list[str] = []
        met = len(b)
        for m in self.pattern.finditer(joint):
            pieces.append(m[0])
            if m.end() - shift in bounds:
                met = m.end() - shift
                break
        middle = [i for p in pieces for i in self.encode(p)]
        kept = left[: len(left) - len(self.encode(a[from_:]))]
        return kept + middle + (self.encode(b[met:]) if met < len(b) else [])


def cuts(texts: list[str]) -> list[tuple[list[int], list[bool]]]:
    """For each text: ends of its chunks, and whether the join after each is sure."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(points)
    h = rolling_hash(points)
    h ^= h >> np.uint64(29)
    hits = np.flatnonzero((h >> np.uint64(17)) % np.uint64(MEAN) == 0) + 1
    # Cuts hang on their own text alone: no window reaches into the text before, no cut moves into the one after.
    own = np.searchsorted(offsets, hits - 1, side="right") - 1
    inside = hits - offsets[own] >= WINDOW
    hits, ends_at = hits[inside], offsets[own[inside] + 1]
    blank = _BLANK[np.minimum(points, 0x3001)]
    sure = np.zeros(n + 1, dtype=bool)
    if n > 2:
        sure[1 : n - 1] = (points[1:-1] == 0x20) & ~blank[:-2] & ~blank[2:]
    places = np.flatnonzero(sure)
    after = np.searchsorted(places, hits)
    moved = np.where(after < len(places), places[np.minimum(after, max(0, len(places) - 1))] if len(places) else n + REACH + 1, n + REACH + 1)
    near = moved - hits <= REACH
    chosen = np.where(near, moved, hits)[~near | (moved < ends_at)]
    order = np.argsort(chosen, kind="stable")
    chosen = chosen[order]
    firsts = np.searchsorted(chosen, offsets[:-1], side="right")
    lasts = np.searchsorted(chosen, offsets[1:], side="left")
    out = []
    for i in range(len(texts)):
        start, end = int(offsets[i]), int(offsets[i + 1])
        ends: list[int] = []
        safe: list[bool] = []
        at = start
        # A cut too near the one before, or an edge, is passed over.
        for c in (*(int(x) for x in chosen[firsts[i] : lasts[i]]), end):
            while c - at > MOST:
                at = at + MOST
                if c - at < 1:
                    break
                ends.append(at - start)
                safe.append(bool(sure[at]))
            if c == end or (c - at >= LEAST and end - c >= LEAST):
                if c > at:
                    ends.append(c - start)
                    safe.append(c == end or bool(sure[c]))
                    at = c
        out.append((ends, safe))
    return out


def cuts_in_turn(texts: list[str]) -> Iterator[tuple[str, list[int], list[bool]]]:
    """(text, ends, sure joins) of each text, some at a time so that the arrays stay small."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= AT_ONCE):
            held += len(texts[end])
            end += 1
        for t, (ends, safe) in zip(texts[at:end], cuts(texts[at:end])):
            yield t, ends, safe
        at = end


def _halves(text: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def encode_corpus(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """key + ids (array<int>) of every text, without special tokens.

    Null and empty texts have no ids: an empty array. Repeated rows (equal key
    and text) come out once; rows of one key with different texts each. A null
    key is a key like others; extra columns are ignored; an empty table gives
    no rows. folder holds the vocabulary file on every executor.
    """
    require(df, key, text)
    path, kind = f"{folder}/{vocabulary}", df.schema[key].dataType.simpleString()
    docs = df.select(col(key).alias("key"), col(text).alias("t"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct chunks of each batch with their number of occurrences."""
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            count: dict[str, int] = {}
            for t, ends, _ in cuts_in_turn(texts):
                at = 0
                for e in ends:
                    piece = t[at:e]
                    count[piece] = count.get(piece, 0) + 1
                    at = e
            marks = [_halves(p) for p in count]
            arrays = [pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "piece", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            ids = [codec.packed(x) for x in codec.encode_batch(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(ids, pa.binary())], ["h1", "h2", "n", "ids"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of each document in order; a text without any has one row without a hash."""
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pick: list[int] = []
            rows: list[tuple] = []
            known: dict[str, tuple[int, int]] = {}
            for i, (t, ends, safe) in enumerate(cuts_in_turn(texts)):
                whole = _halves(t)[0]
                at = 0
                for j, (e, s) in enumerate(zip(ends, safe)):
                    piece = t[at:e]
                    mark = known.get(piece)
                    if mark is None:
                        mark = known[piece] = _halves(piece)
                    rows.append((whole, j, s, *mark))
                    at = e
                if not ends:
                    rows.append((whole, 0, True, None, None))
                pick += [i] * max(1, len(ends))
            cols = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pick, pa.int64())), *arrays], ["key", "whole", "pos", "safe", "h1", "h2"])

    distinct = docs.select("t").mapInArrow(pieces, "h1 bigint, h2 bigint, piece string, n bigint").groupBy("h1", "h2").agg(F.first("piece").alias("piece"), F.sum("n").alias("n"))
    book = settle_table(distinct.select("h1", "h2", "piece", "n").mapInArrow(encode, "h1 bigint, h2 bigint, n bigint, ids binary"), "chunks")
    total = book.agg(F.sum("n")).first()[0] or 0
    # At most 1 / HOT_SHARE chunks of at most MOST characters: a few MB at any size of corpus.
    hot = F.broadcast(book.where(F.col("n") >= max(2, total * HOT_SHARE)).select("h1", "h2", F.col("ids").alias("hot_ids")))
    at = docs.mapInArrow(places, f"key {kind}, whole bigint, pos int, safe boolean, h1 bigint, h2 bigint").join(hot, ["h1", "h2"], "left")
    settled = F.col("hot_ids").isNotNull() | F.col("h1").isNull()
    # Rows that need no join any more get a key of their own, so that none gathers in one partition.
    own1 = F.when(settled, F.xxhash64("key", "whole", "pos")).otherwise(F.col("h1")).alias("j1")
    own2 = F.when(settled, F.lit(-1).cast("bigint")).otherwise(F.coalesce("h2", F.lit(0).cast("bigint"))).alias("j2")
    at = at.select("key", "whole", "pos", "safe", "hot_ids", settled.alias("settled"), own1, own2)
    cold = book.select(F.col("h1").alias("j1"), F.col("h2").alias("j2"), "ids")
    joined = at.join(cold, ["j1", "j2"], "left")
    found = F.when(~F.col("settled") & F.col("ids").isNull(), F.raise_error(F.lit("a chunk is missing from the book of chunks")).cast("binary")).otherwise(F.when(F.col("settled"), F.col("hot_ids")).otherwise(F.col("ids")))
    part = F.struct("pos", "safe", found.alias("ids"))
    grouped = joined.groupBy("key", "whole").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    twice = F.size(F.filter("parts", lambda p: p.pos == 0)) > 1
    grouped = grouped.withColumn("parts", F.when(twice, F.array_distinct("parts")).otherwise(F.col("parts")))
    grouped = grouped.select("key", F.transform("parts", lambda p: F.struct(p.safe.alias("safe"), F.coalesce(p.ids, F.lit(b"")).alias("ids"))).alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts follow each other in the batch's memory, so ids of sure joins need no copying."""
        codec = Codec.of(path)
        for batch in batches:
            parts = batch.column(1)
            flat = parts.flatten()
            safe, data = flat.field("safe"), flat.field("ids")
            starts = np.asarray(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
            sizes = np.asarray(pc.binary_length(data), dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            if pc.all(safe, min_count=0).as_py():
                stream = np.frombuffer(b"".join(data.to_pylist()), dtype=codec.width).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends[starts] // codec.width.itemsize, pa.int32()), pa.array(stream))
            else:
                out = []
                sure_list, data_list = safe.to_pylist(), data.to_pylist()
                for a, b in zip(starts[:-1], starts[1:]):
                    done: list[int] = []
                    tail: list[int] = []  # since the last sure join
                    sure = True
                    for s, d in zip(sure_list[a:b], data_list[a:b]):
                        piece = codec.unpacked(d)
                        if sure:
                            done += tail
                            tail = piece
                        else:
                            tail = codec.join(tail, piece)
                        sure = s
                    out.append(done + tail)
                ids = pa.array(out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    return grouped.mapInArrow(assemble, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
