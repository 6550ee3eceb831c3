"""Flat tables from deeply nested records (problem 2).

A record is shredded into columns, one for each leaf of the schema, whose
entries carry a repetition and a definition level; tables are then put
together from the level sequences alone. Groups that nest in themselves
(chapters in chapters, tags in tags) share a leaf: their definition level is
the depth of nesting, so a record of any depth gives a fixed set of columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.runtime import col, require

#: Group -> the repeated members of its objects, in document order, and the group of their elements.
MEMBERS: dict[str, dict[str, str]] = {
    "container": {"tracks": "track", "chapters": "chapter", "tags": "tag"},
    "track": {},
    "chapter": {"subchapters": "chapter"},
    "tag": {"simpletags": "simple_tag"},
    "simple_tag": {"subtags": "simple_tag"},
}
#: Leaves with a column of their own in the tables of each group, objects inside objects by dots; all others come in one map.
LEAVES: dict[str, list[str]] = {
    "track": ["id", "type", "codec", "language", "name", "isdefault", "isforced", "width", "height", "audio.channels", "audio.samplerate"],
    "chapter": ["id", "title", "startms", "endms"],
    "tag": ["targettype", "targetid"],
    "simple_tag": ["name", "value", "language"],
}
#: A shredded column of a group holds its own chain of groups from the root; level 0 is the record.
MARK = "#"
#: The leaf that holds what has no column.
MORE = "*"

_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\],:]|"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null)[ \t\n\r]*')


def _reject(name: str) -> None:
    raise ValueError(name)


def _parse_deep(text: str) -> object:
    """JSON without recursion, for texts nested deeper than the library allows."""
    end, at, root = len(text), 0, []
    stack: list[tuple[object, str]] = [(root, "")]
    state, key = "value", ""
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("not JSON")
        at, tok = m.end(), m[1]
        box = stack[-1][0]
        if state in ("value", "value_or_close"):
            if tok == "]" and state == "value_or_close":
                stack.pop()
                state = "after"
                continue
            if tok in "{[":
                new: object = {} if tok == "{" else []
            elif tok in "}],:":
                raise ValueError("not JSON")
            else:
                new = json.loads(tok)
            if isinstance(box, list):
                box.append(new)
            else:
                box[key] = new  # type: ignore[index]
            if tok in "{[":
                stack.append((new, tok))
                state = "key_or_close" if tok == "{" else "value_or_close"
            else:
                state = "after"
        elif state in ("key", "key_or_close"):
            if tok == "}" and state == "key_or_close":
                stack.pop()
                state = "after"
            elif tok[0] == '"':
                key, state = json.loads(tok), "colon"
            else:
                raise ValueError("not JSON")
        elif state == "colon":
            if tok != ":":
                raise ValueError("not JSON")
            state = "value"
        else:
            if len(stack) == 1:
                raise ValueError("not JSON")
            if tok == ",":
                state = "key" if stack[-1][1] == "{" else "value"
            elif tok == ("}" if stack[-1][1] == "{" else "]"):
                stack.pop()
            else:
                raise ValueError("not JSON")
        if len(stack) == 1 and state == "after" and at < end:
            raise ValueError("not JSON")
    if len(stack) != 1 or state != "after":
        raise ValueError("not JSON")
    return root[0]


def parse_json(text: str | None) -> object:
    """The value of a JSON text of any depth; None for null, empty or invalid text."""
    if not text:
        return None
    try:
        return json.loads(text, parse_constant=_reject)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return _parse_deep(text)
    except ValueError:
        return None


def _spelled(obj: dict) -> dict:
    """The object with keys regardless of case and underscores; of two spellings the one with a value counts."""
    out: dict = {}
    for k, v in obj.items():
        name = k.replace("_", "").lower()
        if v is not None or name not in out:
            out[name] = v
    return out


def _elements(value: object) -> list[dict]:
    """The objects of a member, however it was written.

    A string stands for the JSON it holds, an object with positions for keys
    (so an empty one too) for an array, another object for an array of one.
    In an array an object is always an element.
    """
    out: list[dict] = []
    todo: list[tuple[object, bool]] = [(value, True)]
    while todo:
        v, whole = todo.pop()
        if isinstance(v, str):
            s = v.strip()
            if s[:1] in ("{", "[", '"'):
                todo.append((parse_json(s), whole))
        elif isinstance(v, list):
            todo.extend((x, False) for x in reversed(v))
        elif isinstance(v, dict):
            if whole and all(k.isascii() and k.isdigit() for k in v):
                todo.extend((v[k], False) for k in sorted(v, key=int, reverse=True))
            else:
                out.append(v)
    return out


def _leaf_text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def leaf_paths(obj: dict, group: str) -> dict[str, str | None]:
    """Every leaf of an object that is no repeated member of its group: path and text.

    Keys are regardless of case and underscores, objects inside are gone into,
    arrays and empty objects are JSON. Of two spellings the one with a value counts.
    """
    out: dict[str, str | None] = {}
    todo: list[tuple[str, dict]] = [("", obj)]
    while todo:
        head, now = todo.pop()
        for k, v in _spelled(now).items():
            if not head and k in MEMBERS[group]:
                continue
            path = head + k
            if isinstance(v, dict) and v:
                todo.append((path + ".", v))
            elif v is not None or path not in out:
                out[path] = None if v is None else _leaf_text(v)
    return out


Column = list[tuple[int, int, object]]


def shred(record: object, leaves: dict[str, list[str]] = LEAVES) -> dict[str, Column]:
    """Columns '<group>.<leaf>' of (repetition level, definition level, value); '<group>.#' marks the instances.

    '<group>.*', where asked for, holds all leaves that have no column of their
    own, as a dict. Level d is reached by the d-th repeated member from the root. A column has
    an entry for each instance of its group and one for each ancestor that has
    none, with the definition level of what is there. Anything but an object
    gives no columns.
    """
    if not isinstance(record, dict):
        return {}
    out: dict[str, Column] = {f"{g}.{leaf}": [] for g in LEAVES for leaf in [MARK, *leaves.get(g, [])]}
    below = {"track": ["track"], "chapter": ["chapter"], "tag": ["tag", "simple_tag"], "simple_tag": ["simple_tag"]}

    def nothing(groups: Iterable[str], r: int, d: int) -> None:
        for g in groups:
            for leaf in [MARK, *leaves.get(g, [])]:
                out[f"{g}.{leaf}"].append((r, d, None))

    root = _spelled(record)
    # (group, element, repetition level, depth); taken from the end, so pushed in reverse.
    stack: list[tuple[str, dict, int, int]] = []

    def push(obj: dict, group: str, r: int, d: int) -> None:
        batch = []
        for member, child in MEMBERS[group].items():
            items = _elements(obj.get(member))
            if not items and child != group:
                nothing(below[child], r, d)
            # In a leaf shared with its parent an element repeats at its own level; elsewhere the first continues its parent.
            batch += [(child, x, r if i == 0 and child != group else d + 1, d + 1) for i, x in enumerate(items)]
        stack.extend(reversed(batch))

    push(root, "container", 0, 0)
    while stack:
        group, element, r, d = stack.pop()
        obj = _spelled(element)
        out[f"{group}.{MARK}"].append((r, d, True))
        own = leaves.get(group, [])
        if own:
            found = leaf_paths(element, group)
            for leaf in own:
                if leaf == MORE:
                    out[f"{group}.{leaf}"].append((r, d, {k: v for k, v in found.items() if v is not None and k not in own}))
                else:
                    out[f"{group}.{leaf}"].append((r, d, found.get(leaf)))
        push(obj, group, r, d)
    return out


#: Definition level of a group's outermost instances, and the group of their parents.
_TOP = {"track": (1, "container"), "chapter": (1, "container"), "tag": (1, "container"), "simple_tag": (2, "tag")}


def assemble(columns: dict[str, Column], group: str) -> Iterator[tuple[int, str, int, int]]:
    """(node, parent_kind, parent_node, entry index) of each instance, from the levels of '<group>.#' alone."""
    top, outer = _TOP[group]
    open_nodes: list[int] = []  # of this group, from the outermost in
    node, ancestor = 0, -1
    for i, (r, d, here) in enumerate(columns.get(f"{group}.{MARK}", [])):
        if outer != "container" and r < top and d >= top - 1:
            ancestor += 1  # below this group's own level each repetition begins a new parent
        if not here or d < top:
            continue
        del open_nodes[d - top :]
        if d == top:
            yield node, outer, 0 if outer == "container" else ancestor, i
        else:
            yield node, group, open_nodes[-1], i
        open_nodes.append(node)
        node += 1


def nested_rows(text: str | None) -> Iterator[tuple[str, int, str, int]]:
    """(kind, node, parent_kind, parent_node) of every object of one record."""
    columns = shred(parse_json(text), {})
    if columns:
        for group in LEAVES:
            for node, parent_kind, parent, _ in assemble(columns, group):
                yield group, node, parent_kind, parent


def _winners(df: DataFrame, key: str, text: str, version: str | None) -> DataFrame:
    require(df, key, text, *([version] if version else []))
    best = F.max(F.struct((col(version) if version else F.lit(0)).alias("v"), col(text).alias("t"))).alias("best")
    return df.groupBy(col(key).alias("key")).agg(best).select("key", F.col("best.t").alias("text"))


def nested_structure(df: DataFrame, key: str, text: str, version: str | None = None) -> DataFrame:
    """key + (kind, node, parent_kind, parent_node): one row for each object of the nested arrays.

    Of several deliveries of a key the one with the greatest version counts
    (then the greatest text, nulls lowest). Null, empty or invalid JSON, and
    JSON that is no object, gives no row; a null key is a key like others.
    Records may be nested to any depth. Extra columns are ignored.
    """
    kind_of = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["key", "kind", "node", "parent_kind", "parent_node"]
            pick: list[int] = []
            cols: list[list] = [[], [], [], []]
            for i, t in enumerate(batch.column(1).to_pylist()):
                for row in nested_rows(t):
                    pick.append(i)
                    for c, v in zip(cols, row):
                        c.append(v)
            arrays = [batch.column(0).take(pa.array(pick, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    out = _winners(df, key, text, version).mapInArrow(run, f"key {kind_of.simpleString()}, kind string, node int, parent_kind string, parent_node int")
    return out.withColumnRenamed("key", key)


def nested_table(df: DataFrame, group: str, key: str, text: str, version: str | None = None) -> DataFrame:
    """One flat table: key + (node, parent_kind, parent_node) + the group's leaves as strings + more.

    group: track, chapter, tag or simple_tag. Rows as in nested_structure(). A
    leaf inside an object has the path of both, dots as underscores; one that is
    absent or null is null, an array is JSON. more maps every other leaf of
    the record that has a value, so that none is lost.
    """
    if group not in LEAVES:
        raise ValueError(f"no such group: {group}; there are {', '.join(LEAVES)}")
    kind_of, leaves = df.schema[key].dataType, LEAVES[group]
    names = [x.replace(".", "_") for x in leaves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick: list[int] = []
            rows: list[tuple[int, str, int]] = []
            values: list[list] = [[] for _ in [*leaves, MORE]]
            for i, t in enumerate(batch.column(1).to_pylist()):
                columns = shred(parse_json(t), {group: [*leaves, MORE]})
                if not columns:
                    continue
                for node, parent_kind, parent, at in assemble(columns, group):
                    pick.append(i)
                    rows.append((node, parent_kind, parent))
                    for c, leaf in zip(values, [*leaves, MORE]):
                        c.append(columns[f"{group}.{leaf}"][at][2])
            arrays = [batch.column(0).take(pa.array(pick, pa.int64())), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), *[pa.array(c, pa.string()) for c in values[:-1]], pa.array([list(x.items()) for x in values[-1]], pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "node", "parent_kind", "parent_node", *[f"v_{x}" for x in names], "v_more"])

    out = _winners(df, key, text, version).mapInArrow(run, f"key {kind_of.simpleString()}, node int, parent_kind string, parent_node int, " + ", ".join(f"v_{x} string" for x in names) + ", v_more map<string,string>")
    return out.select(F.col("key").alias(key), "node", "parent_kind", "parent_node", *[F.col(f"v_{x}").alias(x) for x in [*names, "more"]])
