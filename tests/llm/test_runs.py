import random

import pytest

from cuewright.llm.runs import alike, canonical, event_runs, repeated_spans, within_edits


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits_against_the_full_table():
    rnd = random.Random(1)
    for _ in range(3000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randrange(9)))
        b = "".join(rnd.choice("abc") for _ in range(rnd.randrange(9)))
        assert within_edits(a, b, 2) == (edit_distance(a, b) <= 2)


def test_canonical_forms():
    assert canonical("{\\pos(1,2)}<i>Hold the LINE!</i>\\N") is not None
    assert canonical("{\\an8}<i>Hold the LINE!</i>") == "holdtheline"
    assert canonical("a,b,0,0,0,,x\\Ny", False) == "ab000xy"
    assert canonical("{TL check}Yes\\hno", True) == "yesno" and canonical("{\\p1}", True) is None
    assert canonical(" …♪ ") is None and canonical("") is None and canonical(None) is None
    assert alike("morethantwelve", "morethantwelv3e") is False and alike("morethantwelve", "mOrethantwelv".lower())
    assert not alike("seatnumber12here", "seatnumber13here") and not alike("shorttext", "shorttexx")


def plain_runs(forms):
    out, at = [], 0
    while at < len(forms):
        end = at + 1
        while end < len(forms) and alike(forms[end - 1], forms[end]):
            end += 1
        if end - at > 1:
            out.append((at, end))
        at = end
    return out


def test_symbol_strings_against_a_plain_scan():
    rnd = random.Random(5)
    pool = [None, "abc", "abd", "thelonglinehere", "thelonglinehexe", "thelonglinehexey", "thelonglinehexeyz", "anotherlonglineofwords"]
    for _ in range(2000):
        forms = [rnd.choice(pool) for _ in range(rnd.randrange(14))]
        assert repeated_spans(forms) == plain_runs(forms)


@pytest.mark.parametrize("block", [2, 3, 7, 4096])
def test_runs_across_blocks(spark, block):
    rnd = random.Random(block)
    pool = ["Same text", "<b>SAME</b> text!", "other", " ", None, "The longer line, repeated.", "The longer line, repeatet.", "The longer lines, repeatet."]
    rows, want = [], set()
    for path in ("a", "b", None):
        seqs = sorted(rnd.sample(range(1, 400), 180))
        texts = [rnd.choice(pool[: rnd.choice([2, 8])]) for _ in seqs]
        times = [(rnd.choice([None, 10 * s]), rnd.choice([None, 10 * s + 5])) for s in seqs]
        for a, b in plain_runs([canonical(t) for t in texts]):
            lo = [t[0] for t in times[a:b] if t[0] is not None]
            hi = [t[1] for t in times[a:b] if t[1] is not None]
            want.add((path, seqs[a], seqs[b - 1], b - a, min(lo, default=None), max(hi, default=None)))
        rows += [(path, s, t, *m) for s, t, m in zip(seqs, texts, times)]
    rows += rng_repeat(rnd, rows)
    rnd.shuffle(rows)
    df = spark.createDataFrame([*rows, ("a", None, "Same text", 1, 2)], "path string, seq int, text string, s long, e long").selectExpr("*", "1 as blk", "2 as slot", "'x' as k0")
    got = [tuple(r)[:6] for r in event_runs(df, ["path"], "seq", "text", "s", "e", block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def rng_repeat(rnd, rows):
    return rnd.sample(rows, len(rows) // 3)


def test_empty_and_very_long(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([("a", 1, long, 0, 1), ("a", 2, long + "x", 1, 5)], "path string, seq int, text string, s long, e long")
    assert [tuple(r) for r in event_runs(df, ["path"], "seq", "text", "s", "e").collect()] == [("a", 1, 2, 2, 0, 5, 5)]
    assert event_runs(df.limit(0), ["path"], "seq", "text", "s", "e").count() == 0
