"""Mapping of free-entered values to a reference list (problem 3).

Values are deduplicated, normalised and cut into readings (the whole value,
the parts between delimiters, the words). Character n-grams of the readings
meet those of the reference terms in an inverted index, by a prefix of the
rarest of them that any term near enough must share; candidates are scored by
the cosine of IDF-weighted n-gram vectors and accepted above a threshold and
with a margin over the next entry.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.runtime import col, require, settle_table

NONE = "none"
THRESHOLD = 0.30
MARGIN = 0.03
#: Terms of up to this length are codes: they match only whole.
CODE_LENGTH = 3
#: A reference list of up to this many n-gram rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Terms of one n-gram that one task meets; a more frequent n-gram is split into so many parts.
HOT = 10_000

_DELIMITER = re.compile(r"[\s]*[/,;:=|()\[\]{}<>_&+\"“”]+[\s]*|\s+[-–—]+\s+|(?<=\w)[-–—](?=\w)")
_SPACE = re.compile(r"\s+")


def normal(text: str) -> str:
    """Composed, one case, without invisible characters, edges trimmed."""
    text = unicodedata.normalize("NFKC", text).casefold()
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n")
    return _SPACE.sub(" ", unicodedata.normalize("NFC", text)).strip(" .,;:-–—'\"!?*#")


def bare(form: str) -> str:
    """A normal form without accents and other marks, as typed where a keyboard has none."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", form) if unicodedata.category(c) != "Mn"))


def readings(text: str) -> list[tuple[int, str, bool, bool]]:
    """(rank, form, may be misspelt, is abbreviated) of the parts of a value that may name an entry."""
    raw = unicodedata.normalize("NFKC", text).strip()
    whole = normal(text)
    out: list[tuple[int, str, bool, bool]] = []
    if not whole:
        return out
    short = raw.endswith(".") and not re.search(r"\s", raw.strip())
    out.append((0, whole, True, short))
    parts = [p for p in (normal(x) for x in _DELIMITER.split(raw)) if p]
    for p in parts:
        if p != whole:
            out.append((len(out), p, True, False))
    for p in parts:
        words = p.split(" ")
        if len(words) > 1:
            out += [(len(out) + i, w, False, False) for i, w in enumerate(x for x in map(normal, words) if x)]
    return out


def grams(form: str, open_end: bool) -> list[str]:
    """Pairs and triples of characters, the ends marked; an abbreviation has no end, and a code is one n-gram."""
    if len(form) <= CODE_LENGTH:
        return ["\x02" + form + "\x03"]
    padded = "\x02" + form + ("" if open_end else "\x03")
    return sorted({padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)})


def _spread(df: DataFrame, kind: str) -> DataFrame:
    """key, value -> key, rank, form, fuzzy, short, grams of each reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick: list[int] = []
            out: list[tuple] = []
            for i, v in enumerate(batch.column(1).to_pylist()):
                for rank, form, fuzzy, short in [] if v is None else readings(v):
                    pick.append(i)
                    out.append((rank, form, fuzzy, short, grams(form, short and len(form) >= CODE_LENGTH)))
            cols = list(zip(*out)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pick, pa.int64())), *arrays], ["key", "rank", "form", "fuzzy", "short", "grams"])

    return df.mapInArrow(run, f"key {kind}, rank int, form string, fuzzy boolean, short boolean, grams array<string>")


def reference_terms(ref: DataFrame, code: str, term_columns: Sequence[str]) -> DataFrame:
    """(code, term, grams) of the distinct normalised terms of each entry, with accents and without."""
    require(ref, code, *term_columns)
    flat = ref.select(col(code).cast("string").alias("key"), F.explode(F.array(*[col(c).cast("string") for c in term_columns])).alias("value")).where("key is not null and value is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, t, grams(t, False)) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in dict.fromkeys((normal(v), bare(normal(v)))) if t]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.string())))], ["code", "term", "grams"])

    return flat.mapInArrow(run, "code string, term string, grams array<string>").dropDuplicates(["code", "term"])


def map_values(values: DataFrame, value: str, ref: DataFrame, code: str, term_columns: Sequence[str], threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """value + (code, score): every distinct value with the entry it means, or 'none'.

    values may repeat a value any number of times: it is mapped once. A null
    value gives a row with 'none', as does a blank one, and every one if the
    list is empty. Whole readings win over misspelt ones; of equal scores the
    earlier reading counts, and a value whose best two entries are closer than
    the margin is 'none'. Single words of a value, and codes, count only whole.
    Extra columns are ignored.
    """
    require(values, value)
    distinct = values.groupBy(col(value).cast("string").alias("value")).agg(F.lit(1).alias("_one")).select("value")
    keyed = distinct.where("value is not null").select(F.col("value").alias("key"), "value")
    # Written once: the value side is normalised in Python and read by three consumers, the list's by five.
    spread = settle_table(_spread(keyed, "string"), "readings")
    terms = settle_table(reference_terms(ref, code, term_columns), "terms")
    # IDF over the reference terms; one row for each (gram, term): the inverted index.
    postings = terms.select("code", "term", F.explode("grams").alias("gram"))
    n_terms = terms.agg(F.count(F.lit(1)).alias("n_terms"))
    idf = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n_terms)).select("gram", F.log(1 + F.col("n_terms") / F.col("df")).alias("idf"), F.ceil(F.col("df") / HOT).cast("int").alias("parts"))
    weighed = postings.join(idf, "gram")
    listed = weighed.groupBy("code", "term").agg(F.collect_list(F.struct("gram", "idf")).alias("own"), F.sqrt(F.sum(F.col("idf") ** 2)).alias("norm"))
    index = weighed.select("gram", "code", "term", F.pmod(F.xxhash64("code", "term"), F.col("parts").cast("bigint")).cast("int").alias("part"))
    few = terms.select(F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda df: df)

    # A gram that no term has weighs as the rarest one would.
    top = F.log(F.lit(1.0) + F.col("n_terms"))
    query = spread.select("key", "rank", F.explode("grams").alias("gram"))
    query = query.join(hint(idf), "gram", "left").crossJoin(F.broadcast(n_terms)).withColumn("q", F.coalesce("idf", top))
    # What is left without a gram and all rarer ones must reach the threshold alone, or no near term can do without them.
    reading = Window.partitionBy("key", "rank")
    tail = F.sqrt(F.sum(F.col("q") ** 2).over(reading.orderBy("q", "gram").rowsBetween(Window.unboundedPreceding, 0)))
    norm = F.sqrt(F.sum(F.col("q") ** 2).over(reading))
    prefix = query.withColumn("_tail", tail).withColumn("_norm", norm).where("parts is not null").where(F.col("_tail") >= threshold * F.col("_norm") - 1e-9)
    asked = prefix.select("key", "rank", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = asked.join(hint(index), ["gram", "part"]).select("key", "rank", "code", "term").distinct()
    vectors = query.groupBy("key", "rank").agg(F.map_from_entries(F.collect_list(F.struct("gram", "q"))).alias("mine"), F.sqrt(F.sum(F.col("q") ** 2)).alias("q_norm"))
    met = pairs.join(vectors, ["key", "rank"]).join(hint(listed), ["code", "term"]).join(spread.select("key", "rank", "form", "fuzzy", "short"), ["key", "rank"])
    dot = F.aggregate("own", F.lit(0.0), lambda acc, g: acc + g.idf * F.coalesce(F.try_element_at(F.col("mine"), g.gram), F.lit(0.0)))
    scored = met.withColumn("score", dot / (F.col("norm") * F.col("q_norm")))
    whole = F.col("form") == F.col("term")
    near = F.col("fuzzy") & (F.length("form") > CODE_LENGTH) & (F.length("term") > CODE_LENGTH)
    begins = F.col("short") & (F.length("form") >= CODE_LENGTH) & (F.length("term") > CODE_LENGTH) & F.col("term").startswith(F.col("form"))
    kept = scored.where(whole | ((near | begins) & (F.col("score") >= threshold)))
    best = kept.withColumn("score", F.when(whole, 1.0).otherwise(F.least("score", F.lit(0.999)))).groupBy("key", "rank", "code").agg(F.max("score").alias("score"))
    in_reading = Window.partitionBy("key", "rank").orderBy(F.col("score").desc(), "code")
    ranked = best.withColumn("_place", F.row_number().over(in_reading)).withColumn("_second", F.lead("score").over(in_reading)).where("_place = 1")
    clear = ranked.where(F.col("_second").isNull() | (F.col("score") - F.col("_second") >= margin))
    chosen = clear.groupBy("key").agg(F.max_by(F.struct("code", "score"), F.struct("score", -F.col("rank"))).alias("c")).select("key", F.col("c.code").alias("code"), F.col("c.score").alias("score"))
    out = distinct.join(chosen, distinct["value"] == chosen["key"], "left")
    return out.select(F.col("value").alias(value), F.coalesce("code", F.lit(NONE)).alias("code"), F.coalesce("score", F.lit(0.0)).alias("score"))
