"""Template residue and error-page text in documents (problem 10).

Labelled exemplars of residue stand in an inverted index. Every document is
cut into passage windows; a window retrieves the exemplars that share a rare
enough word with it, those it contains by TF-IDF weight cover their words in
it, and a document with a window that is covered for the greater part is
excluded. Word weights come from the document frequencies of the whole corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.residue_exemplars import CLASSES, EXEMPLARS, MENTION, MENTION_TOGETHER, SLOTS, STRONG
from cuewright.runtime import col, require

#: Document frequencies of words that no exemplar has are kept in this many hash buckets (2 MB). A bucket has the words of at
#: most a few hundredths of a percent of the documents however many there are, so such a word's weight stays above STRANGER.
BUCKETS = 1 << 18
#: Share of an exemplar's weight that a window must hold, and share of a window's weight that must be covered.
CONTAINED, COVERED = 0.7, 0.6
#: Matched weight that stands for containment in long exemplars (eight words that one document in 150 has).
EVIDENCE = 40.0
#: A window as long as an exemplar that holds this much weight of it, and CLOSE of all its words, is residue inside running text.
SPLICED, CLOSE = 7.0, 0.8
#: Words of an exemplar that counts inside running text; fewer are what people say. Words beside a placeholder that may tell it is spoken of.
SPLICED_WORDS, BESIDE, NEAR = 4, 3, 9
#: A window whose weight lies to this share in words of one group's exemplars, and comes to this much there, is that group's.
OF_GROUP, GROUP_WEIGHT = 0.9, 9.0
#: Weight that a word which no exemplar has may reach: it speaks against a match, but a rare one not more than others.
STRANGER = 4.0
#: Windows of a passage longer than this many words, and their step.
LONGEST, WINDOW, STEP = 40, 16, 8

#: Paths, words, numbers, placeholder tokens, and what ends a passage.
_WORD = re.compile(r"(?:/[\w.-]+){2,}|[^\W\d]+(?:['’-][^\W\d]+)*|\d(?:[\w/.-]*\w)?|\x02[a-z ]+\x02|[.!?…]+(?=[\s\"”’)\]]|$)|[\n|]|[;:](?=\s)")
_PLAIN_WORD = re.compile(r"(?:/[\w.-]+){2,}|[^\W\d]+(?:['’-][^\W\d]+)*")
#: What a placeholder has at least one of; cheaper than trying all shapes everywhere.
_SLOT_SIGN = re.compile(r"\{[{%A-Za-z_]|<[%a-z]|[$#]\{|%[(A-Z]|\$[A-Z]|\[\[|@@|__[A-Z]|«[a-z]|\[(?:INSERT|TK|TB|TODO)|\sto\s+be\s+(?:inserted|added|confirmed|supplied)\]|XXX")
_SLOT = re.compile("|".join(f"(?P<s{i}>{p})" for i, p in enumerate(SLOTS.values())))
_SLOT_NAMES = list(SLOTS)


#: What stands in quotation marks inside a sentence is spoken of, but for placeholders.
_QUOTATION = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|\"[^\"]*\"")
_QUOTED = re.compile(r"[“„\"«‘`']\s?\Z"), re.compile(r"\s?[”“\"»’`']")


def _slot_token(m: re.Match) -> str:
    # A placeholder in quotation marks of its own is spoken of.
    if _QUOTED[0].search(m.string[max(0, m.start() - 2) : m.start()]) and _QUOTED[1].match(m.string, m.end()):
        return " "
    return f" \x02{_SLOT_NAMES[int(m.lastgroup[1:])]}\x02 "  # type: ignore[index]


def marked(text: str) -> str:
    """The text with unfilled placeholders replaced by the token of their shape."""
    return _SLOT.sub(_slot_token, text) if _SLOT_SIGN.search(text) else text


#: Each word of a class, and the class's token.
_CLASS = {w: f"\x03{name}" for name, listed in CLASSES.items() for w in listed.split()}
#: Classes that count once where their words follow each other; a repeated text is filler.
_ONCE = frozenset(f"\x03{name}" for name in CLASSES if name != "body")
_MENTION, _MENTION_TOGETHER = frozenset(_CLASS.get(w, w) for w in MENTION.split()), frozenset(_CLASS.get(w, w) for w in MENTION_TOGETHER.split())


class _Kept(dict):
    """What a function gives, kept once asked for."""

    def __init__(self, make: Callable[[str], Any]) -> None:
        self.make = make

    def __missing__(self, w: str) -> Any:
        if len(self) > 500_000:
            self.clear()
        out = self[w] = self.make(w)
        return out


def _fold(w: str) -> str:
    """A word as it counts; what ends a passage is the empty word."""
    return "" if w[0] in ".!?…\n|;:" else "0" if w[0].isdigit() or w[0] == "/" or "_" in w else _CLASS.get(w, w)


_FOLDED = _Kept(_fold)


def _folded(text: str) -> list[str]:
    """Words in lower case as they count, '' between passages."""
    out = [_FOLDED[w] for w in _WORD.findall(text.lower())]
    return [w for w, before in zip(out, ["", *out]) if w != before or w not in _ONCE]


def words(text: str) -> list[str]:
    """Words in lower case, folded into their classes; numbers, paths and names with underscores are '0' and weigh nothing."""
    return [w for w in _folded(text) if w]


def vocabulary(text: str) -> set[str]:
    """The different words and classes of a text, without words of digits."""
    return {_CLASS.get(w, w) for w in set(_PLAIN_WORD.findall(text.lower()))}


def spoken_of(ws: list[str], at: int) -> bool:
    """Whether the words beside a placeholder speak of it."""
    if not _MENTION.isdisjoint(ws[max(0, at - BESIDE) : at + BESIDE + 1]):
        return True
    return len(_MENTION_TOGETHER.intersection(ws[max(0, at - NEAR) : at + NEAR + 1])) > 1


#: Words of exemplars have places of their own after the buckets, so their frequencies are exact.
_KNOWN = {w: BUCKETS + i for i, w in enumerate(sorted({w for t in EXEMPLARS.values() for w in words(t)}))}
TABLE = BUCKETS + len(_KNOWN)


def bucket(word: str) -> int:
    known = _KNOWN.get(word)
    if known is not None:
        return known
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def _windows(folded: list[str]) -> Iterator[list[str]]:
    start, n = 0, len(folded)
    while start < n:
        try:
            end = folded.index("", start)
        except ValueError:
            end = n
        if end - start > LONGEST:
            ws = folded[start:end]
            for at in range(0, len(ws) - WINDOW + STEP, STEP):
                yield ws[at : at + WINDOW]
        elif end > start:
            yield folded[start:end]
        start = end + 1


def windows(text: str) -> Iterator[list[str]]:
    """Passages between sentence ends and line breaks; long ones as overlapping windows."""
    return _windows(_folded(text))


class Index:
    """Exemplars by their heaviest words, with weights from document frequencies."""

    def __init__(self, counts: np.ndarray, n_docs: int) -> None:
        self.counts, self.n_docs = counts, max(1, n_docs)
        self.weights = _Kept(self._weigh)
        self.groups = {label: {w for x in t.strip().split("\n") for w in words(x)} for label, t in EXEMPLARS.items() if label != "filler"}
        self.strong = {f"\x03{name}" for name in STRONG.split()}
        self.exemplars: list[tuple[Counter, float, str]] = []
        self.anchors: dict[str, list[int]] = {}
        self.inside: dict[str, list[int]] = {}
        for label, text in EXEMPLARS.items():
            for line in dict.fromkeys(tuple(words(x)) for x in text.strip().split("\n")):
                self._add(Counter(line), label)
        for shape in SLOTS:
            self._add(Counter([f"\x02{shape}\x02"]), "slot")

    def _weigh(self, word: str) -> float:
        if word == "0":
            return 0.0
        if word[0] == "\x02":
            return 12.0
        w = max(0.0, math.log((self.n_docs + 1) / (float(self.counts[bucket(word)]) + 0.5)))
        return w if word in _KNOWN else min(w, STRANGER)

    def weight(self, word: str) -> float:
        return self.weights[word]

    def _add(self, bag: Counter, label: str) -> None:
        total = sum(n * self.weight(w) for w, n in bag.items())
        if total <= 0:
            return
        number = len(self.exemplars)
        self.exemplars.append((bag, total, label))
        # Prefix filter: a window without any of these words can't hold enough of the exemplar.
        need = min(CONTAINED * total, EVIDENCE)
        rest = total
        for w in sorted(bag, key=lambda x: (-bag[x] * self.weight(x), x)):
            if rest < need:
                break
            self.anchors.setdefault(w, []).append(number)
            rest -= bag[w] * self.weight(w)
        # The same for exemplars that count inside running text, which must be held nearly whole.
        if label == "slot" or (total >= SPLICED and SPLICED_WORDS <= bag.total() <= LONGEST):
            rest = total
            for w in sorted(bag, key=lambda x: (-bag[x] * self.weight(x), x)):
                if rest < CLOSE * total:
                    break
                self.inside.setdefault(w, []).append(number)
                rest -= bag[w] * self.weight(w)

    def covered(self, ws: list[str]) -> tuple[float, str | None]:
        """Share of a window's weight that contained exemplars cover, and the label of the one that holds most."""
        if self.anchors.keys().isdisjoint(ws):
            return 0.0, None
        candidates = {e for w in ws for e in self.anchors.get(w, ())}
        weights, bag = self.weights, Counter(ws)
        total = sum(n * weights[w] for w, n in bag.items())
        if total <= 0:
            return 0.0, None
        mine: set[str] = set()
        best, label = 0.0, None
        for e in sorted(candidates):
            wanted, weight, kind = self.exemplars[e]
            held = sum(min(n, bag[w]) * weights[w] for w, n in wanted.items() if w in bag)
            if held >= min(CONTAINED * weight, EVIDENCE):
                mine.update(wanted)
                if held > best:
                    best, label = held, kind
        share = sum(n * weights[w] for w, n in bag.items() if w in mine) / total
        if share < COVERED and not self.strong.isdisjoint(bag):
            for kind, group in self.groups.items():
                inside = sum(n * weights[w] for w, n in bag.items() if w in group)
                if inside >= GROUP_WEIGHT and inside >= OF_GROUP * total:
                    return inside / total, kind
        return share, label

    def spliced(self, ws: list[str], slots: bool) -> str | None:
        """The label of an exemplar that stands nearly word for word somewhere in a window; of placeholders, or of all else."""
        weights = self.weights
        for at, w in enumerate(ws):
            for e in self.inside.get(w, ()):
                wanted, weight, kind = self.exemplars[e]
                size = wanted.total()
                if (kind == "slot") != slots:
                    continue
                if slots:
                    if not spoken_of(ws, at):
                        return kind
                    continue
                for start in range(max(0, at - size + 1), min(at, max(0, len(ws) - size)) + 1):
                    bag = Counter(ws[start : start + size])
                    held = sum(min(n, bag[x]) * weights[x] for x, n in wanted.items() if x in bag)
                    if held >= SPLICED and held >= CLOSE * max(weight, sum(n * weights[x] for x, n in bag.items())):
                        return kind
        return None

    def label(self, text: str | None) -> str | None:
        """The kind of residue in a text, or None."""
        if not text:
            return None
        text = marked(text)
        folded = _folded(text)
        if self.anchors.keys().isdisjoint(folded):
            return None
        near = []
        slots, weights = "\x02" in text, self.weights
        for ws in _windows(folded):
            if self.anchors.keys().isdisjoint(ws):
                continue
            total = sum([weights[w] for w in ws])
            # Exemplars cover words of theirs only.
            theirs = sum([weights[w] for w in ws if w in _KNOWN or w[0] == "\x02"])
            if theirs >= COVERED * total:
                share, label = self.covered(ws)
                if label is not None and share >= COVERED:
                    return label
            if slots and self.spliced(ws, True) is not None:
                return "slot"
            if theirs >= SPLICED and not self.inside.keys().isdisjoint(ws):
                near.append(ws)
        # Only windows with one of the words that such an exemplar can't do without matter.
        if near and _QUOTATION.search(text):
            near = list(windows(_QUOTATION.sub(" ” ", text)))
        for ws in near:
            inside = self.spliced(ws, False)
            if inside is not None:
                return inside
        return None


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents that have a word of each hash bucket, and their number; over all rows with text."""
    require(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TABLE, dtype=np.int64)
        n = 0
        known: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                n += 1
                here = set()
                for w in vocabulary(t):
                    b = known.get(w)
                    if b is None:
                        if len(known) > 500_000:
                            known.clear()
                        b = known[w] = bucket(w)
                    here.add(b)
                counts[list(here)] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(counts[used], n), pa.int64())], ["bucket", "n"])

    # At most TABLE + 1 rows reach the driver.
    rows = df.select(col(text).alias("t")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(TABLE, dtype=np.int64)
    total = 0
    for r in rows:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            counts[r["bucket"]] = r["n"]
    return counts, total


def label_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """key + label of the rows whose text holds residue: slot, filler, error, script, cookie or sign-in.

    Null and blank texts hold none. Repeated rows come out once, a null key is
    a key like others, extra columns are ignored, an empty table gives nothing.
    Whole texts of any length are read.
    """
    require(df, key, text)
    kind = df.schema[key].dataType.simpleString()
    counts, total = document_frequencies(df, text)
    shared = df.sparkSession.sparkContext.broadcast((counts.astype(np.int64), total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            found = [index.label(t) for t in batch.column(1).to_pylist()]
            at = [i for i, x in enumerate(found) if x is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([found[i] for i in at], pa.string())], ["key", "label"])

    out = df.select(col(key).alias("key"), col(text).alias("t")).where("t is not null").mapInArrow(run, f"key {kind}, label string")
    return out.distinct().withColumnRenamed("key", key)
