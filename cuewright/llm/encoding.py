"""Text garbled by decoding with a wrong character encoding (problem 5).

Expectation-maximization with a latent encoding chain per record. A chain is
a series of (wrong encoding, right encoding) steps; undoing it gives the text
that was meant. How likely that text is, against the text as it stands, comes
from a character model of the corpus, itself re-estimated from the tokens with
their likeliest repairs. Weak evidence of single records is pooled: each pool
of one source and field has its own chain frequencies, estimated over all its
records. A record is then judged, and repaired, by its posterior.
"""

from __future__ import annotations

import codecs
import math
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.runtime import col, require, settle, settle_table

#: The character model is a table of hashed n-gram counts, and one of whole pieces: so many slots each for a different piece
#: of the corpus, in powers of two between the bounds (2 to 32 MB).
SLOTS_A_PIECE, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 18, 1 << 22
#: Sources and fields share this many pools at most.
POOLS = 4096
MODEL_ROUNDS, EM_ROUNDS = 4, 6
#: Log-likelihood that a token's repair must gain, which is also its price; the gain from which it counts for the
#: character model; the log-likelihood ratio of characters that are gone for good.
GAIN, SURE_GAIN, LOSSY = 2.0, 0.5, 25.0
#: Log-likelihood that a part's repair may fall short of the part where the record is known to be garbled by the chain.
KNOWN_GARBLED = 3.0
#: Pseudo-count of each chain in a pool, over all chains together.
SMOOTHING = 1.0

#: Letters, digits and all that isn't ASCII: what the character model sees; the rest is markup and punctuation.
_PIECE = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_HIGH_RUN = re.compile(r"[^\x00-\x7f]+")
_TOKEN = re.compile(r"[^ \t\n\r]+")
#: Two signs on end that several-byte text misread as western has.
_FOREIGN = re.compile(r"[\x80-\xff‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸŽ€]{2}")
_LOST = re.compile(r"�")
_ACCENTED = re.compile(r"[\u00c0-\u024f]")
_LATIN = re.compile(r"[A-Za-z]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_IDEOGRAPH = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_MIXED = re.compile(r"[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z]")
_LETTERLIKE = re.compile(r"[^\x00-\x7f‘’“”„–—…«»°§·¿¡]")
_BOXES = re.compile(r"[\u2500-\u259f]")
_WORD_WITH_PLAIN = re.compile(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]")
#: Signs between letters, or several on end: words have none.
_SIGNS = re.compile(r"\w[¡-©«-±´¶¸»¿\xa0‚„†‡‰‹›€™]\w|[¤¦¨©¬®±¶¸¹²³¼½¾¿][ª²³¹¤¦¨©¬®±¶¸¼½¾¿]|[\w][²³¹][^\W\d]")
_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")

#: Encodings whose undefined bytes were kept as control characters, as browsers do.
_SINGLE = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-15", "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac_roman"]
_WESTERN = ["cp1252", "latin-1"]
_LEGACY = ["cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7", "cp1250", "iso8859-2", "cp852", "euc_jp", "cp932", "gbk", "big5", "euc_kr", "cp437", "cp850", "mac_roman"]

_WIDE = {"euc_jp", "cp932", "gbk", "big5", "euc_kr"}

Step = tuple[str, str]


#: Steps that occur most, and more than once on one text.
_TWICE: list[Step] = [(w, "utf-8") for w in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251")]


def _chains() -> list[tuple[Step, ...]]:
    out: list[tuple[Step, ...]] = [((w, "utf-8"),) for w in _SINGLE]
    out += [((w, t),) for t in _LEGACY for w in _WESTERN]
    cyrillic = ["cp1251", "koi8-r", "cp866"]
    out += [((w, t),) for w in cyrillic for t in cyrillic if w != t]
    out += [((w, "cp1252"),) for w in _SINGLE if w not in ("latin-1", "cp1252", "iso8859-15", "iso8859-9", "cp1254")]
    out += [(a, b) for a in _TWICE for b in _TWICE]
    out += [(a, a, a) for a in _TWICE[:2]]
    return out


#: The chains beside 'as it stands'; a step's wrong encoding is encoded to, its right one decoded from.
CHAINS = _chains()
_WIDE_CHAINS = [k for k, chain in enumerate(CHAINS) if chain[0][1] in _WIDE]
_OTHER_CHAINS = [k for k, chain in enumerate(CHAINS) if chain[0][1] not in _WIDE]


def _byte_table(name: str) -> dict[int, int]:
    table: dict[int, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(ord(c), b)
    for b in range(0x80, 0xA0):
        table.setdefault(b, b)
    return table


_BYTES = {name: _byte_table(name) for name in _SINGLE}


def _pair(name: str) -> re.Pattern:
    """A lead byte of UTF-8 and a continuation byte, as characters of the encoding."""
    lead = "".join(re.escape(chr(c)) for c, b in _BYTES[name].items() if 0xC2 <= b <= 0xF4)
    rest = "".join(re.escape(chr(c)) for c, b in _BYTES[name].items() if 0x80 <= b <= 0xBF)
    return re.compile(f"[{lead}][{rest}]")


_PAIR = {name: _pair(name) for name in _SINGLE}


def _misread_losses() -> list[str]:
    """What the mark of a lost character becomes when its UTF-8 bytes are misread, once or more."""
    # Bytes 80 to 9F come as signs or as control characters.
    signs = {name: [{b: chr(c) for c, b in items} for items in (table.items(), reversed(table.items()))] for name, table in _BYTES.items()}
    out: set[str] = set()
    for chain in CHAINS:
        if all(right == "utf-8" for _, right in chain):
            texts = {"\ufffd"}
            for wrong, _ in reversed(chain):
                texts = {"".join(sign[b] for b in text.encode()) for text in texts for sign in signs[wrong]}
            out |= texts
    return sorted(out, key=lambda x: (-len(x), x))


_MISREAD_LOSS = re.compile("|".join(map(re.escape, _misread_losses())))


@lru_cache(maxsize=64)
def _encoded(token: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(token, "strict", _BYTES[name])[0]
    except UnicodeEncodeError:
        return None


def _undo(token: str, step: Step) -> str | None:
    wrong, right = step
    if right != "utf-8":
        data = _encoded(token, wrong)
        try:
            return None if data is None else data.decode(right)
        except UnicodeDecodeError:
            return None
    if not _PAIR[wrong].search(token):
        return None
    table = _BYTES[wrong]
    try:
        return codecs.charmap_encode(token, "strict", table)[0].decode(right)
    except UnicodeError:
        pass
    changed = False

    def run(m: re.Match) -> str:
        nonlocal changed
        try:
            out = codecs.charmap_encode(m[0], "strict", table)[0].decode(right)
        except UnicodeError:
            return m[0]
        changed = True
        return out

    out = _HIGH_RUN.sub(run, token)
    return out if changed else None


def _westernish(text: str, right: str) -> bool:
    """Whether Latin letters stand beside decoded ones in a word of which they are a third of the bytes or more."""
    for m in _WORD.finditer(text):
        latin = len(_LATIN.findall(m[0]))
        if latin and not m[0].isascii() and 2 * latin >= sum(b >= 0x80 for b in m[0].encode(right, "replace")):
            return True
    return False


def undo_chain(token: str, chain: Sequence[Step]) -> str | None:
    """The token before the chain, or None where it can't have come from it."""
    now: str | None = token
    for step in chain:
        now = _undo(now, step)  # type: ignore[arg-type]
        if now is None:
            return None
    if now == token or not now or _LOST.search(now) or _MISREAD_LOSS.search(now):
        return None
    # Text of the scripts that need several bytes a character may hold digits, tags and Latin words, but western words hold none of it.
    if chain[0][1] in _WIDE and (_ACCENTED.search(now) or not _IDEOGRAPH.search(now) or _westernish(now, chain[0][1])):
        return None
    if chain[0][1] != "utf-8":
        # Punctuation alone is no sign of a wrong single-byte encoding, nor do words hold box-drawing characters.
        if not _LETTERLIKE.search(token) or _BOXES.search(now):
            return None
        # A word is of one script; and a western word that was misread keeps its plain letters.
        if _MIXED.search(now) and not _MIXED.search(token):
            return None
        if chain[0][1] == "cp1252" and not _WORD_WITH_PLAIN.search(token):
            return None
    return now


def untrusted(token: str) -> bool:
    """Whether a token looks like misread bytes: valid UTF-8 in a common encoding, or signs inside a word."""
    if _CONTROL.search(token) or _LOST.search(token) or _SIGNS.search(token):
        return True
    return any(_undo(token, step) not in (None, token) for step in _TWICE)


def _slot(gram: str, size: int) -> int:
    """The place of an n-gram; pieces ('\\x06' before them) stand in a table of their own after it."""
    place = zlib.crc32(gram.encode("utf-32-le", "surrogatepass")) & (size - 1)
    return place + size if gram[0] == "\x06" else place


def table_size(n_pieces: int) -> int:
    """Slots of each table for a corpus of so many different pieces."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SLOTS_A_PIECE * n_pieces - 1).bit_length()))


def _grams(token: str) -> Iterator[str]:
    t = "\x02" + token + "\x03"
    for i in range(1, len(t)):
        yield t[i]
        yield t[i - 1 : i + 1]
        if i > 1:
            yield t[i - 2 : i + 1]
        # Contexts, counted where something follows.
        yield "\x04" + t[i - 1]
        if i > 1:
            yield "\x04" + t[i - 2 : i]


class Model:
    """Interpolated character trigrams over hashed counts, with what each token's chains gain."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, self.size = counts, len(counts) // 2
        self.total = max(1.0, float(counts[_slot("\x05", self.size)]))
        self.gains: dict[tuple[str, bool], list[tuple[int, float]]] = {}
        self.probabilities: dict[str, float] = {}

    def _n(self, gram: str) -> float:
        return float(self.counts[_slot(gram, self.size)])

    def log_probability(self, token: str, least: float = -math.inf) -> float:
        """Of the whole token; once it falls below least, whatever it has come to."""
        t = "\x02" + token + "\x03"
        out = 0.0
        for i in range(1, len(t)):
            gram = t[max(0, i - 2) : i + 1]
            p = self.probabilities.get(gram)
            if p is None:
                if len(self.probabilities) > 300_000:
                    self.probabilities.clear()
                c = t[i]
                one = (self._n(c) + 0.02) / (self.total + 0.02 * 50_000)
                two = self._n(t[i - 1 : i + 1])
                under = self._n("\x04" + t[i - 1])
                p = (two + 2.0 * one) / (under + 2.0)
                if i > 1:
                    p = (self._n(gram) + 2.0 * p) / (self._n("\x04" + t[i - 2 : i]) + 2.0)
                p = self.probabilities[gram] = math.log(max(p, 1e-12))
            out += p
            if out < least:
                break
        return out

    def _text_probability(self, text: str, least: float = -math.inf) -> float:
        out = 0.0
        for piece in _PIECE.findall(text):
            out += self.log_probability(piece, least - out)
            if out < least:
                break
        return out

    def gain(self, token: str, wide: bool = False) -> list[tuple[int, float]]:
        """(chain, log-likelihood gained, its price off) of the chains that make a token likelier by more.

        Chains of encodings with several bytes a character look at tokens between
        spaces, since signs may be their bytes; the others at the pieces of these.
        """
        key = (token, wide)
        known = self.gains.get(key)
        if known is not None:
            return known
        out = self.gained(token, ((k, undo_chain(token, CHAINS[k])) for k in (_WIDE_CHAINS if wide else _OTHER_CHAINS)))
        if len(self.gains) > 200_000:
            self.gains.clear()
        self.gains[key] = out
        return out

    def gained(self, token: str, undone: Iterable[tuple[int, str | None]]) -> list[tuple[int, float]]:
        """(chain, gain) of the chains that make a token likelier, from what each makes of it."""
        out = []
        own = None
        seen: dict[str, float] = {}
        for k, back in undone:
            if back is None:
                continue
            if own is None:
                own = self._text_probability(token)
            p = seen.get(back)
            if p is None:
                p = seen[back] = self._text_probability(back, own + GAIN)
            if p - own >= GAIN:
                out.append((k, p - own - GAIN))
        return out

    def likeliest(self, piece: str, doubtful: bool, undone: dict[int, str]) -> str | None:
        """A piece as it was most likely meant, of what chains make of it; None if it can't be told."""
        gains = [g for g in self.gained(piece, undone.items()) if g[1] >= SURE_GAIN]
        if not gains:
            return None if doubtful else piece
        back = undone[max(gains, key=lambda g: (g[1], -g[0]))[0]]
        return back if doubtful or self._n("\x06" + back) >= self._n("\x06" + piece) else piece

    def evidence(self, text: str) -> dict[int, float]:
        """Log-likelihood ratio of each chain with any; -1 stands for loss that no chain explains."""
        out: dict[int, float] = {}
        for piece in _PIECE.findall(text):
            if not piece.isascii():
                for k, g in self.gain(piece):
                    out[k] = out.get(k, 0.0) + g
        if _FOREIGN.search(text):
            for token in _TOKEN.findall(text):
                if not token.isascii() and _FOREIGN.search(token):
                    for k, g in self.gain(token, True):
                        out[k] = out.get(k, 0.0) + g
        if _LOST.search(text) or _MISREAD_LOSS.search(text):
            out[-1] = LOSSY
        elif _CONTROL.search(text) and not out:
            out[-1] = LOSSY / 2
        return out

    def repair(self, text: str, chain: int) -> str:
        """The text with the parts undone that the chain, known to have garbled it, may have made; all else stays as it is."""
        wide = CHAINS[chain][0][1] in _WIDE

        def undone(m: re.Match) -> str:
            back = None if m[0].isascii() else undo_chain(m[0], CHAINS[chain])
            if back is None or self._text_probability(back) < self._text_probability(m[0]) - KNOWN_GARBLED:
                return m[0]
            return back

        return (_TOKEN if wide else _PIECE).sub(undone, text)


def _tokens(rows: DataFrame) -> DataFrame:
    """token, n: the pieces with other than ASCII characters, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[str, int] = {}
            for t in batch.column(0).to_pylist():
                for piece in _PIECE.findall(t):
                    if not piece.isascii():
                        count[piece] = count.get(piece, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["token", "n"])

    return rows.select("t").mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _undone(tokens: DataFrame) -> DataFrame:
    """token, n + doubtful, chains, backs: what each chain makes of a token, found once for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doubtful, chains, backs = [], [], []
            for token in batch.column(0).to_pylist():
                found = [] if _LOST.search(token) else [(k, undo_chain(token, CHAINS[k])) for k in (*_OTHER_CHAINS, *_WIDE_CHAINS)]
                found = [x for x in found if x[1] is not None]
                doubtful.append(untrusted(token))
                chains.append([k for k, _ in found])
                backs.append([t for _, t in found])
            arrays = [*batch.columns, pa.array(doubtful, pa.bool_()), pa.array(chains, pa.list_(pa.int32())), pa.array(backs, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["token", "n", "doubtful", "chains", "backs"])

    # The table is small and its rows costly: let every core have some.
    spread = tokens.repartition(2 * tokens.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, "token string, n bigint, doubtful boolean, chains array<int>, backs array<string>")


def _count_model(tokens: DataFrame, before: np.ndarray | None, size: int) -> np.ndarray:
    """Hashed n-gram counts of the tokens, repaired by the model before."""
    spark = tokens.sparkSession
    shared = None if before is None else spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if shared is None else Model(shared.value)
        counts = np.zeros(2 * size, dtype=np.float64)
        slots: dict[str, int] = {}
        for batch in batches:
            for token, n, doubtful, chains, backs in zip(*[c.to_pylist() for c in batch.columns]):
                weight = float(n)
                if _LOST.search(token):
                    continue
                # At first only tokens that can't be bytes of UTF-8 are believed, later all in their likeliest form.
                token = (None if doubtful else token) if model is None else model.likeliest(token, doubtful, dict(zip(chains, backs)))
                if token is None:
                    continue
                counts[_slot("\x06" + token, size)] += weight
                for gram in _grams(token):
                    s = slots.get(gram)
                    if s is None:
                        if len(slots) > 300_000:
                            slots.clear()
                        s = slots[gram] = _slot(gram, size)
                    counts[s] += weight
                counts[_slot("\x05", size)] += weight * (len(token) + 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.float64())], ["slot", "n"])

    # At most twice the table's size in rows reaches the driver.
    rows = tokens.mapInArrow(run, "slot bigint, n double").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * size, dtype=np.float32)
    counts[np.asarray(rows.column("slot"))] = np.asarray(rows.column("n"))
    if shared is not None:
        shared.unpersist()
    return counts


def character_model(df: DataFrame, text: str, rounds: int = MODEL_ROUNDS) -> np.ndarray:
    """Counts of a character model of the column, garbled tokens replaced by their likeliest repairs."""
    rows = df.select(col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]"))
    tokens = settle_table(_undone(_tokens(rows)), "tokens")
    size = table_size(max(1, tokens.count()))
    counts = _count_model(tokens, None, size)
    for _ in range(rounds - 1):
        counts = _count_model(tokens, counts, size)
    return counts


def garbled_records(df: DataFrame, keys: Sequence[str], text: str, source: str, field: str, em_rounds: int = EM_ROUNDS, repaired: bool = False) -> DataFrame:
    """keys + (chain, posterior) of the records that are garbled, wholly or in part.

    chain names the steps undone ('loss' where characters are gone for good);
    posterior is that of any garbling. With repaired, restored_text holds the
    text with the likeliest chain undone, null for 'loss'. source and field
    name the columns whose pairs make the pools. Without repaired, of several
    texts of one key the most surely garbled one gives the row; with it each has
    one. Null, empty and plain ASCII
    texts are never garbled. Repeated rows come out once; null keys are keys
    like others; extra columns are ignored; an empty table gives no rows.
    """
    require(df, *keys, text, source, field)
    ks = [f"k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{a} {df.schema[k].dataType.simpleString()}" for k, a in zip(keys, ks))
    pool = F.pmod(F.xxhash64(F.coalesce(col(source).cast("string"), F.lit("")), F.coalesce(col(field).cast("string"), F.lit(""))), F.lit(POOLS).cast("bigint")).cast("int")
    rows = df.select(*[col(k).alias(a) for k, a in zip(keys, ks)], pool.alias("pool"), col(text).alias("t"))
    high = F.col("t").rlike(r"[^\x00-\x7f]")
    counts = character_model(rows, "t")
    spark = df.sparkSession
    model_shared = spark.sparkContext.broadcast(counts)
    nk = len(ks)
    listed = "chains array<int>, ratios array<float>"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_shared.value)
        for batch in batches:
            pick, chains, ratios = [], [], []
            for i, t in enumerate(batch.column(nk + 1).to_pylist()):
                found = model.evidence(t)
                if found:
                    pick.append(i)
                    chains.append(list(found))
                    ratios.append(list(found.values()))
            at = pa.array(pick, pa.int64())
            kept = [batch.column(i).take(at) for i in range(nk + 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(chains, pa.list_(pa.int32())), pa.array(ratios, pa.list_(pa.float32()))], [*ks, "pool", "t", "chains", "ratios"])

    # Deliveries of one text count once; different texts of one key are records each until they are judged.
    found = rows.where(high).mapInArrow(judge, f"{kinds}, pool int, t string, {listed}").dropDuplicates([*ks, "pool", "t"])
    suspects = settle_table(found if repaired else found.drop("t"), "suspects")
    # Records with equal evidence weigh together in the rounds.
    patterns = settle(suspects.groupBy("pool", "chains", "ratios").agg(F.count(F.lit(1)).alias("n")))
    size = rows.where("t is not null").groupBy("pool").agg(F.count(F.lit(1)).alias("n")).collect()  # at most POOLS rows
    totals = {r["pool"]: r["n"] for r in size}
    n_chains = len(CHAINS) + 1

    def posterior(prior: np.ndarray, chains: list[int], ratios: list[float]) -> tuple[list[float], float]:
        """Of each listed chain, and of 'as it stands'."""
        logs = [math.log(prior[c]) + r for c, r in zip(chains, ratios)] + [math.log(prior[n_chains])]
        top = max(logs)
        each = [math.exp(x - top) for x in logs]
        s = sum(each)
        return [x / s for x in each[:-1]], each[-1] / s

    def priors(expected: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Chain -1 is at index -2, 'as it stands' at the end."""
        out = {}
        for p, n in totals.items():
            e = expected.get(p, np.zeros(n_chains))
            share = (e + SMOOTHING / n_chains) / (n + SMOOTHING + 1.0)
            out[p] = np.append(share, max(0.05, 1.0 - share.sum()))
        return out

    # Chain k is at index k, 'loss' (-1) at index len(CHAINS).
    index = lambda c: len(CHAINS) if c < 0 else c
    now = priors({p: np.full(n_chains, 0.01 * n / n_chains) for p, n in totals.items()})
    for _ in range(em_rounds):
        shared = spark.sparkContext.broadcast(now)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for p, chains, ratios, n in zip(*[c.to_pylist() for c in batch.columns]):
                    at = [index(c) for c in chains]
                    each, _ = posterior(shared.value[p], at, ratios)
                    acc = sums.setdefault(p, np.zeros(n_chains))
                    for a, x in zip(at, each):
                        acc[a] += n * x
            out = [(p, k, float(x)) for p, acc in sums.items() for k, x in enumerate(acc) if x > 0]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64()))], ["pool", "k", "x"])

        got = patterns.mapInArrow(expect, "pool int, k int, x double").groupBy("pool", "k").agg(F.sum("x").alias("x")).collect()  # at most POOLS x chains rows
        expected: dict[int, np.ndarray] = {}
        for r in got:
            expected.setdefault(r["pool"], np.zeros(n_chains))[r["k"]] = r["x"]
        now = priors(expected)
        shared.unpersist()
    final = spark.sparkContext.broadcast(now)
    names = [" + ".join(f"{t} read as {w}" for w, t in reversed(chain)) for chain in CHAINS] + ["loss"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_shared.value) if repaired else None
        at_chains = nk + 1 + repaired
        for batch in batches:
            pick, chain, sure, text_out = [], [], [], []
            texts = batch.column(nk + 1).to_pylist() if repaired else []
            for i, (p, chains, ratios) in enumerate(zip(batch.column(nk).to_pylist(), batch.column(at_chains).to_pylist(), batch.column(at_chains + 1).to_pylist())):
                at = [index(c) for c in chains]
                each, stands = posterior(final.value[p], at, ratios)
                if stands < 0.5:
                    best = at[max(range(len(each)), key=lambda j: (each[j], -at[j]))]
                    pick.append(i)
                    chain.append(names[best])
                    sure.append(1.0 - stands)
                    if model is not None:
                        text_out.append(None if best == len(CHAINS) else model.repair(texts[i], best))
            where = pa.array(pick, pa.int64())
            more = [pa.array(text_out, pa.string())] if repaired else []
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(where) for i in range(nk)], pa.array(chain, pa.string()), pa.array(sure, pa.float64()), *more], [*ks, "chain", "posterior", *(["restored_text"] if repaired else [])])

    out = suspects.mapInArrow(decide, f"{kinds}, chain string, posterior double{', restored_text string' if repaired else ''}")
    if not repaired:
        best = F.max_by(F.struct("chain", "posterior"), F.struct("posterior", "chain")).alias("b")
        out = out.groupBy(*ks).agg(best).select(*ks, "b.*")
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "chain", "posterior", *(["restored_text"] if repaired else []))
