import random

import pytest

from cuewright.operators.intervals import periods_and_gaps


def brute(rows, limit):
    out, by = set(), {}
    for k, a, b in rows:
        if a is not None and b is not None and b > a:
            by.setdefault(k, []).append((a, b))
    for k, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:]) if limit is None or y[0] - x[1] < limit}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_spans_against_a_plain_sweep(spark, seed):
    rnd, rows = random.Random(seed), []
    for _ in range(400):
        k = rnd.choice(["a", "a", "a", "b", None])
        a = rnd.choice([None, rnd.randrange(-300, 3000), rnd.randrange(-300, 3000), rnd.randrange(0, 100) * 100])
        length = rnd.choice([0, 5, 7, 20, 100, 350, -4]) if seed % 2 else rnd.choice([1, 2, 3, 100 if rnd.random() < 0.05 else 2])
        rows.append((k, a, None if a is None or rnd.random() < 0.02 else a + length))
    df = spark.createDataFrame(rows * 2, "k string, s long, e long").selectExpr("*", "1 as lo", "2 as shard", "3 as `_k0`", "4 as start_ms")
    got = [tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", shard_ms=100, no_gap_from_ms=60).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 60)


def test_empty_and_touching(spark):
    df = spark.createDataFrame([("a", 0, 600_000), ("a", 600_000, 1_200_000), ("a", 1_200_001, 9_000_000_000_000)], "k string, s long, e long")
    assert {tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e").collect()} == {("a", "period", 0, 1_200_000), ("a", "period", 1_200_001, 9_000_000_000_000), ("a", "gap", 1_200_000, 1_200_001)}
    assert periods_and_gaps(df.limit(0), ["k"], "s", "e").count() == 0
