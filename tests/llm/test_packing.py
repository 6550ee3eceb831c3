import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cuewright.llm.packing import container_limits, pack_items, pack_summary, pack_vectors, token_counts
from cuewright.llm.tokens import TOKENIZER_FOLDER, VOCABULARY


def plain_dot_product(demand, limits):
    """The same heuristic item by item."""
    sizes = np.asarray(demand, float) / np.asarray(limits, float)
    weight = sizes.sum(axis=0)
    weight = weight / weight.sum()
    left, bins = set(range(len(sizes))), []
    while left:
        free, now = np.ones(len(limits)), []
        while True:
            fit = [i for i in left if (sizes[i] <= free + 1e-12).all()]
            if not fit:
                break
            best = max(fit, key=lambda i: (round(float((sizes[i] * weight) @ free), 12), tuple(sizes[i])))
            now.append(best)
            left.discard(best)
            free = free - sizes[best]
        bins.append(now)
    return bins


def test_vectors_against_the_plain_heuristic():
    for seed in range(20):
        rnd = random.Random(seed)
        demand = np.array([[rnd.randrange(1, 60), 1, rnd.randrange(0, 40)] for _ in range(60)])
        limits = (100, 5, 60)
        bins, plain = pack_vectors(demand, limits), plain_dot_product(demand, limits)
        assert sorted(i for b in bins for i in b) == list(range(60))
        assert all((demand[b].sum(axis=0) <= limits).all() for b in bins)
        assert len(bins) == len(plain) and [sorted(map(tuple, demand[b])) for b in bins] == [sorted(map(tuple, demand[b])) for b in plain]
    assert pack_vectors(np.zeros((0, 3)), (1, 1, 1)) == []


def test_nothing_is_lost_or_split_without_need(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, 3, 7, 20, 55, 99, 100, 101, 350]), rnd.randrange(0, 50)) for i in range(700)] + [(None, 5, 5), (9000, None, None), (1, 3, 3), (1, 3, 3)]
    df = spark.createDataFrame(rows, "k long, n long, l long").selectExpr("*", "1 as part", "2 as shard", "3 as `key`")
    for share, most in ((1.0, 1000), (0.5, 7), (0.98, None)):
        out = pack_items(df, "k", "n", "l", [(1, 100), (2, 1000)], shard_rows=200, max_segments=most, loss_share=share).collect()
        for pack, capacity in ((1, 100), (2, 1000)):
            own = [r for r in out if r["pack_id"] == pack]
            used, segments, loss = Counter(), Counter(), Counter()
            limit, most_loss = container_limits(capacity, most, share)
            for r in own:
                loss[r["shard"], r["container"]] += min(r["n_loss_tokens"], most_loss)
                used[r["shard"], r["container"]] += r["n_tokens"]
                segments[r["shard"], r["container"]] += 1
            assert max(used.values()) <= capacity and max(segments.values()) <= limit and max(loss.values()) <= most_loss
            assert sum(r["n_loss_tokens"] for r in own) == sum(min(n or 0, lo or 0) for _, n, lo in rows)
            got = defaultdict(list)
            for r in own:
                got[r["k"]].append((r["part"], r["start"], r["n_tokens"]))
            want = Counter()
            for k, n, _ in rows:
                want[k] += n or 0
            assert {k: sum(p[2] for p in v) for k, v in got.items()} == dict(want)
            assert len(got[1]) >= 3 and got[9000] == [(0, 0, 0)]
            assert all(len(v) == 1 or want[k] > capacity or k == 1 for k, v in got.items())
            if share == 1.0:
                total = sum(used.values())
                assert len(used) <= 1.1 * total / capacity + 8
        report = pack_summary(pack_items(df.where("k > 1 and n > 0"), "k", "n", "l", [(1, 100), (2, 1000)], max_segments=most, loss_share=share), "k", most, share).collect()
        assert [(r["n_over_tokens"], r["n_over_segments"], r["n_over_loss"], r["n_divided"]) for r in report] == [(0, 0, 0, 0)] * 2
        assert share == 1.0 or any(r["n_at_segments"] + r["n_at_loss"] for r in report)
    assert pack_items(df.limit(0), "k", "n", "l", [(1, 100)]).count() == 0
    assert pack_items(df, "k", "n", "l", []).count() == 0


@pytest.mark.skipif(not os.path.exists(f"{TOKENIZER_FOLDER}/{VOCABULARY}"), reason="no vocabulary files here")
def test_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (4, "(Applause.)"), (5, "x " * 50_000)], "d long, t string")
    got = {r["d"]: (r["n_tokens"], r["n_loss_tokens"]) for r in token_counts(df, ["d"], "t").collect()}
    assert got[1] == got[2] == (0, 0) and got[3] == (3, 3) and got[4][0] > 0 and got[4][1] == 0 and got[5][0] > 49_000


@pytest.mark.skipif(not os.path.isdir(TOKENIZER_FOLDER), reason="no tokenizer here")
def test_loss_tokens_are_counted_from_the_tokens(spark):
    from cuewright.llm.tokens import Codec

    codec = Codec.of(f"{TOKENIZER_FOLDER}/{VOCABULARY}")
    texts = ["I rise. [żółć żółć żółć] The bridge stands.", "Yes (12 34 56 78 90 ☃☃☃) and no [Applause].", "ü (x)(y) ü [z", "no brackets at all", "[all of it]", ""]
    rows = {r["i"]: r for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], "t").collect()}
    for i, t in enumerate(texts):
        inside = [False] * len(t.encode())
        for part in ("[żółć żółć żółć]", "(12 34 56 78 90 ☃☃☃)", "[Applause]", "(x)", "(y)", "[all of it]"):
            if part in t:
                start = t.encode().index(part.encode())
                inside[start : start + len(part.encode())] = [True] * len(part.encode())
        ids, at, want = codec.encode(t), 0, 0
        for x in ids:
            at += len(codec.encoding.decode_single_token_bytes(x))
            want += not inside[at - 1]
        assert (rows[i]["n_tokens"], rows[i]["n_loss_tokens"]) == (len(ids), want), t
