import json
import random

from cuewright.operators.nested import _parse_deep, nested_rows, nested_structure, nested_table, parse_json

SPELL = {"sub_chapters": ["sub_chapters", "subChapters", "SubChapters", "SUB_CHAPTERS"], "simple_tags": ["simple_tags", "simpleTags"], "sub_tags": ["sub_tags", "subTags", "SubTags"], "tracks": ["tracks", "Tracks"], "chapters": ["chapters", "Chapters"], "tags": ["tags", "TAGS"]}
CHILD = {"container": [("tracks", "track"), ("chapters", "chapter"), ("tags", "tag")], "track": [], "chapter": [("sub_chapters", "chapter")], "tag": [("simple_tags", "simple_tag")], "simple_tag": [("sub_tags", "simple_tag")]}


def build(rnd, kind, depth, rows, counters, parent):
    """A random record beside the rows that a plain walk over it gives."""
    obj = {"name": f"n{rnd.random():.3f}"}
    for member, child in CHILD[kind]:
        n = rnd.choice([0, 0, 1, 2, 3]) if depth < 6 else 0
        if rnd.random() < 0.1 and n == 0:
            obj[rnd.choice(SPELL[member])] = rnd.choice([None, []])
            continue
        items = []
        for _ in range(n):
            node = counters.get(child, 0)
            counters[child] = node + 1
            rows.append((child, node, kind, parent))
            items.append(build(rnd, child, depth + 1, rows, counters, node))
        form = rnd.choice(["list", "list", "nulls", "lone", "positions", "text", "inner text"])
        value = items
        if form == "nulls":
            value = [x for i in items for x in (None, i)]
        elif form == "lone" and n == 1:
            value = items[0]
        elif form == "positions" and n:
            value = {str(i): x for i, x in reversed(list(enumerate(items)))}
        elif form == "text":
            value = json.dumps(items)
        elif form == "inner text":
            value = [json.dumps(x) for x in items]
        if n:
            obj[rnd.choice(SPELL[member])] = value
    return obj


def test_random_records_against_a_plain_walk():
    for seed in range(300):
        rnd, rows = random.Random(seed), []
        record = build(rnd, "container", 0, rows, {}, 0)
        assert sorted(nested_rows(json.dumps(record))) == sorted(rows)


def test_any_depth():
    deep = '{"chapters":' + '[{"sub_chapters":' * 30_000 + "[]" + "}]" * 30_000 + "}"
    rows = list(nested_rows(deep))
    assert len(rows) == 30_000 and rows[-1] == ("chapter", 29_999, "chapter", 29_998)


def test_deep_parser_agrees_with_the_library():
    good = ['{"a": [1, -2.5e3, true, null, "x\\u00e9\\n"], "b": {}}', "[]", "{}", ' [ {"k":[]} , "" ] ']
    for t in good:
        assert _parse_deep(t) == json.loads(t)
    for t in ['{"a":1', "[1,]", '{"a" 1}', "[] []", "", "]", '{"a":01}', '{,}', "[1 2]"]:
        try:
            _parse_deep(t)
        except ValueError:
            continue
        raise AssertionError(t)
    assert parse_json("NaN") is None and parse_json('{"a": Infinity}') is None


def test_deliveries_nulls_and_invalid(spark):
    rows = [(1, '{"tracks": {"id": 1}}', 5), (1, '{"tracks": []}', 4), (1, '{"tracks": {"id": 1}}', 5), (2, None, 1), (3, "", 1), (4, "{", 1), (5, '["x"]', 1), (6, '"text"', None), (None, '{"tags": [{"simple_tags": {"name": "A"}}, {}, {"simple_tags": [{"name": "B"}]}]}', None)]
    df = spark.createDataFrame(rows, "scan_id long, probe_json string, at int").selectExpr("*", "1 as kind", "2 as node", "3 as `key`", "'x' as `probe.json`")
    got = sorted(map(tuple, nested_structure(df, "scan_id", "probe_json", "at").collect()), key=str)
    assert got == sorted([(1, "track", 0, "container", 0), (None, "tag", 0, "container", 0), (None, "tag", 1, "container", 0), (None, "tag", 2, "container", 0), (None, "simple_tag", 0, "tag", 0), (None, "simple_tag", 1, "tag", 2)], key=str)
    tags = nested_table(df, "simple_tag", "scan_id", "probe_json", "at").collect()
    assert sorted((r["name"], r["parent_node"]) for r in tags) == [("A", 0), ("B", 2)]
    assert nested_structure(df.limit(0), "scan_id", "probe_json").count() == 0


def test_no_leaf_is_lost(spark):
    record = {"tracks": [{"ID": 1, "Audio": {"channels": 2, "Sample_Rate": 48000.0, "layout": {"name": "5.1"}}, "flags": [1, {"x": None}], "empty": {}, "name": None, "Name": "n", "hidden": None}], "chapters": [{"title": "t", "colour": "é", "sub_chapters": [{"title": 5}]}]}
    df = spark.createDataFrame([(1, json.dumps(record))], "scan_id long, probe_json string")
    row = nested_table(df, "track", "scan_id", "probe_json").first()
    assert (row["id"], row["audio_channels"], row["audio_samplerate"], row["name"], row["codec"]) == ("1", "2", "48000.0", "n", None)
    assert row["more"] == {"audio.layout.name": "5.1", "flags": '[1, {"x": null}]', "empty": "{}"}
    got = nested_table(df, "chapter", "scan_id", "probe_json").orderBy("node").collect()
    assert [(r["title"], r["more"]) for r in got] == [("t", {"colour": "é"}), ("5", {})]
