import random

from cuewright.operators.replica_diff import replica_differences, unequal_cells


def test_random_copies_against_dictionaries(spark):
    rnd = random.Random(3)
    words = [None, "", "a", "b", "A"]
    base = {(rnd.choice([None, f"p{i}"]), i % 7): (rnd.choice(words), rnd.choice(words)) for i in range(900)}
    other = {k: v if rnd.random() > 0.05 else (rnd.choice(words), v[1]) for k, v in base.items() if rnd.random() > 0.03} | {("new", 1): ("a", "b")}

    def rows(d):
        out = [(*k, *v, 9) for k, v in d.items()]
        out += [(*k, "old", None, rnd.choice([None, 3])) for k in d if rnd.random() < 0.2]
        out += rnd.sample(out, 50)
        rnd.shuffle(out)
        return spark.createDataFrame(out, "path string, n int, x string, y string, at int").selectExpr("*", "1 as bucket", "2 as k0", "3 as v")

    want = {(*k, "missing_in_replica", None, None) for k in base.keys() - other.keys()} | {(*k, "missing_in_primary", None, None) for k in other.keys() - base.keys()}
    for k in base.keys() & other.keys():
        want |= {(*k, f, base[k][i], other[k][i]) for i, f in enumerate("xy") if base[k][i] != other[k][i]}
    a, b = rows(base), rows(other)
    for n in (None, 1, 64):
        got = [tuple(r) for r in replica_differences(a, b, ["path", "n"], ["x", "y"], "at", n_buckets=n).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # The second field never differs beyond missing keys, so only key changes flag it.
    assert unequal_cells(a, a, ["path", "n"], ["x", "y"], "at", 64).count() == 0


def test_empty_copies(spark):
    a = spark.createDataFrame([("p", "x")], "k string, f string")
    assert [tuple(r)[:2] for r in replica_differences(a, a.limit(0), ["k"], ["f"]).collect()] == [("p", "missing_in_replica")]
    assert [tuple(r)[:2] for r in replica_differences(a.limit(0), a, ["k"], ["f"]).collect()] == [("p", "missing_in_primary")]
    assert replica_differences(a.limit(0), a.limit(0), ["k"], ["f"]).count() == 0
