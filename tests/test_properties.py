"""Properties that hold for any input."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.operators.nested import _parse_deep, nested_rows
from cuewright.sources import ebml as X


@given(st.integers(0, (1 << 56) - 2))
def test_sizes_come_back(n):
    raw = X.size_bytes(n)
    assert X.read_vint(raw) == (n, len(raw)) == (n, X.size_width(n))


@given(st.integers(2, 70_000))
def test_padding_has_its_size(n):
    pad = X.void(n)
    size, w = X.read_vint(pad, 1)
    assert len(pad) == n and 1 + w + size == n


@given(st.lists(st.binary(max_size=600), min_size=1, max_size=9))
def test_xiph_laces_come_back(frames):
    head = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    body = b"\x81\0\0\x02" + bytes([len(frames) - 1]) + head + b"".join(frames)
    assert X.block_frames(body, True)[3] == frames


@given(st.integers(1, 100), st.integers(-32768, 32767), st.booleans(), st.binary(max_size=100))
def test_blocks_come_back(track, rel, key, data):
    node = X.decode_master(X.encode_block(track, rel, key, data))
    assert X.block_frames(node.last("simple_block"), True) == (track, rel, key, [data])


@given(st.dictionaries(st.sampled_from(["title", "muxing_app"]), st.text(alphabet=st.characters(exclude_characters="\0", exclude_categories=["Cs"]), max_size=50)))
def test_texts_come_back(values):
    node = X.decode_master(b"".join(X.encode(k, v) for k, v in values.items()))
    assert {k: node.last(k) for k in values} == values


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=200)
@given(json_values)
def test_deep_parser_reads_what_the_library_writes(value):
    for text in (json.dumps(value), json.dumps(value, indent=1, ensure_ascii=False)):
        assert _parse_deep(text) == json.loads(text)


@given(json_values)
def test_any_json_gives_rows_with_known_parents(value):
    rows = list(nested_rows(json.dumps({"chapters": value, "tags": value, "tracks": value})))
    nodes = {(k, n) for k, n, _, _ in rows} | {("container", 0)}
    assert len(nodes) == len(rows) + 1 and all((pk, pn) in nodes and (pk != k or pn < n) for k, n, pk, pn in rows)
