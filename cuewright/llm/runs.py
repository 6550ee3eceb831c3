"""Runs of repeated consecutive events (problem 1).

Symbol-string regex: the canonical form of each event is mapped to a Unicode
code point, the code points of an entity are joined to a string, and a
back-reference finds its repetitions, whose spans are mapped back to sequence
numbers and times. An entity is cut into blocks of consecutive sequence
numbers, so that one with a third of all events is spread over many tasks; a
second, small stage joins runs that cross a block's edge.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.runtime import col, require

BLOCK = 4096
#: Keys that a task remembers to drop repeated deliveries before the shuffle.
REMEMBERED = 50_000

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|<\d+:\d\d(?::\d\d)?[.,]\d+>", re.S)
_CODE = re.compile(r"\{\s*\\[^{}]*\}|\{[A-Za-z]:[^{}]*\}")
_BRACE = re.compile(r"\{[^{}]*\}")
_BREAK = re.compile(r"\\[Nnh]")
_NOT_WORD = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"\d+")
_REPEAT = re.compile(r"(.)\1+", re.S)


def visible_text(text: str, ass: bool) -> str:
    """What is shown: the text without tags, override codes and (ASS) comments in braces."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "{" in text:
        text = (_BRACE if ass else _CODE).sub("", text)
    if "\\" in text:
        text = _BREAK.sub(" ", text)
    return text


def canonical(text: str | None, ass: bool = False) -> str | None:
    """Letters and digits of the visible text in one case; None if there are none."""
    if text is None:
        return None
    seen = visible_text(text, ass)
    if not seen.isascii():
        seen = unicodedata.normalize("NFKC", seen)
    return _NOT_WORD.sub("", seen.casefold()) or None


def ass_text(fields: str | None) -> str | None:
    """The Text part of a Dialogue line's fields; None if they are null or cut short."""
    if fields is None:
        return None
    parts = fields.split(",", 6)
    return parts[6] if len(parts) == 7 else None


def within_edits(a: str, b: str, k: int) -> bool:
    """Whether at most k insertions, deletions or substitutions turn a into b."""
    todo = [(0, 0, k)]
    la, lb = len(a), len(b)
    while todo:
        i, j, left = todo.pop()
        while i < la and j < lb and a[i] == b[j]:
            i += 1
            j += 1
        if i == la or j == lb:
            if la - i + lb - j <= left:
                return True
            continue
        if left and abs((la - i) - (lb - j)) <= left:
            todo += [(i + 1, j, left - 1), (i, j + 1, left - 1), (i + 1, j + 1, left - 1)]
    return False


def alike(a: str | None, b: str | None) -> bool:
    """Equal canonical forms, or at most two edits between forms of twelve or more with the same numbers."""
    if a is None or b is None:
        return False
    if a == b:
        return True
    if len(a) < 12 or len(b) < 12 or abs(len(a) - len(b)) > 2:
        return False
    return within_edits(a, b, 2) and _NUMBER.findall(a) == _NUMBER.findall(b)


def symbols(forms: Sequence[str | None]) -> str:
    """One code point for each event: neighbours have the same one just if they are alike."""
    known: dict[str, str] = {}
    free = 0x100
    out: list[str] = []
    before: str | None = None
    for form in forms:
        if out and alike(before, form):
            out.append(out[-1])
        else:
            sign = known.get(form) if form is not None else None
            if sign is None or (out and sign == out[-1]):
                if free == 0xD800:
                    free = 0xE000  # past the surrogates
                sign = chr(free)
                free += 1
            out.append(sign)
        if form is not None:
            known[form] = out[-1]
        before = form
    return "".join(out)


def repeated_spans(forms: Sequence[str | None]) -> list[tuple[int, int]]:
    """[first, end) of the longest runs of two or more events, each alike to the one before."""
    return [m.span() for m in _REPEAT.finditer(symbols(forms))]


_OUT = ["k", "first_seq", "last_seq", "n_events", "start_ms", "end_ms"]


def _low(x: int | None, y: int | None) -> int | None:
    return y if x is None else x if y is None else min(x, y)


def _high(x: int | None, y: int | None) -> int | None:
    return y if x is None else x if y is None else max(x, y)


def event_runs(df: DataFrame, keys: Sequence[str], seq: str, text: str, start: str, end: str, ass: str | None = None, block: int = BLOCK) -> DataFrame:
    """keys + (first_seq, last_seq, n_events, start_ms, end_ms, duration_ms) of each run.

    A run is a longest stretch of two or more events, consecutive by seq in an
    entity, each alike to the one before. Null or blank texts (no letter or
    digit shown) are alike to none and end a run. Repeated deliveries of a key
    count once; if they disagree, the greatest canonical form counts, nulls
    lowest. Rows with a null seq have no place in the order and are left out;
    a null entity is one of its own. Times: the earliest start and latest end
    present, null if none is. ass names a boolean column: text then holds
    Dialogue fields. Empty table: no rows. Extra columns are ignored.
    """
    require(df, *keys, seq, text, start, end, *([ass] if ass else []))
    ks = [f"k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{a} {df.schema[k].dataType.simpleString()}" for k, a in zip(keys, ks))
    rows = df.select(*[col(k).alias(a) for k, a in zip(keys, ks)], col(seq).cast("long").alias("seq"), col(text).alias("t"), (col(ass) if ass else F.lit(False)).alias("ass"), col(start).cast("long").alias("s"), col(end).cast("long").alias("e")).where("seq is not null")
    nk = len(ks)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            pick, out = [], []
            for i, (t, ass_row) in enumerate(zip(cols[nk + 1], cols[nk + 2])):
                form = canonical(ass_text(t) if ass_row else t, ass_row)
                at_key = tuple(c[i] for c in cols[: nk + 1])
                content = (form, cols[nk + 3][i], cols[nk + 4][i])
                if seen.get(at_key) == content:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[at_key] = content
                pick.append(i)
                out.append(form)
            at = pa.array(pick, pa.int64())
            kept = [batch.column(i).take(at) for i in (*range(nk + 1), nk + 3, nk + 4)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.string())], [*ks, "seq", "s", "e", "form"])

    formed = rows.mapInArrow(forms, f"{kinds}, seq bigint, s bigint, e bigint, form string")
    formed = formed.withColumn("blk", F.floor(F.col("seq") / F.lit(block)).cast("long"))
    blocks = formed.repartition(*ks, "blk").sortWithinPartitions(*ks, "blk", "seq", F.col("form").desc_nulls_last(), "s", "e")

    # Of each block: its inner runs (slot = block), and a head and a tail row that a neighbour may continue (slot -1).
    fields = ["slot", "blk", "part", "first_seq", "last_seq", "n", "s", "e", "form_a", "form_b"]
    made = f"{kinds}, slot bigint, blk bigint, part int, first_seq bigint, last_seq bigint, n bigint, s bigint, e bigint, form_a string, form_b string"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        group: tuple | None = None
        held: list[tuple] = []  # (seq, s, e, form)

        def flush() -> None:
            if not held:
                return
            spans = repeated_spans([h[3] for h in held])
            n, key, blk = len(held), list(group[:-1]), group[-1]  # type: ignore[index]
            head = spans[0] if spans and spans[0][0] == 0 else (0, 1)
            tail = spans[-1] if spans and spans[-1][1] == n else (n - 1, n)
            for a, b in {head, tail, *spans}:
                s = e = None
                for h in held[a:b]:
                    s, e = _low(s, h[1]), _high(e, h[2])
                edge = (a, b) in (head, tail)
                part = (1 if (a, b) == head else 0) + (2 if (a, b) == tail else 0)
                out.append([*key, -1 if edge else blk, blk, part, held[a][0], held[b - 1][0], b - a, s, e, held[a][3] if edge else None, held[b - 1][3] if edge else None])

        def emit() -> pa.RecordBatch:
            types = [batch.schema.field(i).type for i in range(nk)] + [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made_rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], ty) for i, ty in enumerate(types)], [*ks, *fields])
            out.clear()
            return made_rows

        batch = None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                here = (*row[:nk], row[nk + 4])
                if here != group:
                    flush()
                    group, held = here, []
                if held and held[-1][0] == row[nk]:
                    old = held[-1]
                    held[-1] = (old[0], _low(old[1], row[nk + 1]), _high(old[2], row[nk + 2]), old[3])
                    continue
                held.append(row[nk : nk + 4])
            if len(out) > 20_000:
                yield emit()
        flush()
        if out:
            yield emit()

    cut = blocks.mapInArrow(runs, made)
    edges = cut.repartition(*ks, "slot").sortWithinPartitions(*ks, "slot", "blk", "first_seq")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        group: tuple | None = None
        held: list | None = None  # first_seq, last_seq, n, s, e, last form

        def flush() -> None:
            if held is not None and held[2] > 1:
                out.append([*group, *held[:5]])  # type: ignore[misc]

        def emit() -> pa.RecordBatch:
            types = [batch.schema.field(i).type for i in range(nk)] + [pa.int64()] * 5
            made_rows = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], ty) for i, ty in enumerate(types)], [*ks, *_OUT[1:]])
            out.clear()
            return made_rows

        batch = None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key, (slot, _, part, first, last, n, s, e, form_a, form_b) = row[:nk], row[nk:]
                if slot != -1:
                    out.append([*key, first, last, n, s, e])
                    continue
                if key == group and held is not None and part & 1 and alike(held[5], form_a):
                    held = [held[0], last, held[2] + n, _low(held[3], s), _high(held[4], e), form_b]
                else:
                    flush()
                    group, held = key, [first, last, n, s, e, form_b]
            if len(out) > 20_000:
                yield emit()
        flush()
        if out:
            yield emit()

    done = edges.mapInArrow(stitch, f"{kinds}, first_seq bigint, last_seq bigint, n_events bigint, start_ms bigint, end_ms bigint")
    kind = df.schema[seq].dataType
    return done.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], F.col("first_seq").cast(kind).alias("first_seq"), F.col("last_seq").cast(kind).alias("last_seq"), "n_events", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
