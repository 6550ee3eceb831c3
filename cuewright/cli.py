"""Command line: python -m cuewright COMMAND ...; -h lists the commands."""

from __future__ import annotations

import argparse
import base64
import json
import sys
from collections.abc import Iterator, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import __version__, api
from cuewright.functions.scalars import clock_time, format_bytes
from cuewright.operators.containers import issue_text
from cuewright.runtime import task_progress

#: A patch given to edit; absent members keep what is there, lists replace the whole list.
PATCH = {"title": str, "tracks": list, "chapters": list, "tags": list}


def session() -> SparkSession:
    spark = SparkSession.builder.appName("cuewright").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def numbers(text: str) -> list[int]:
    try:
        return [int(x) for x in text.split(",") if x.strip()]
    except ValueError:
        raise argparse.ArgumentTypeError(f"not a list of numbers: {text}") from None


def spans(text: str) -> list[tuple[int, int]]:
    out = []
    for part in text.split(","):
        a, dash, b = part.partition("-")
        if not dash or not a.strip().isdigit() or not b.strip().isdigit():
            raise argparse.ArgumentTypeError(f"not a range of milliseconds: {part}")
        out.append((int(a), int(b)))
    return out


def track_input(text: str) -> api.TrackInput:
    path, colon, track = text.rpartition(":")
    if not colon or not track.isdigit():
        raise argparse.ArgumentTypeError(f"not FILE:TRACK: {text}")
    return api.TrackInput(path, int(track), is_default=True)


def _show(df: DataFrame, as_json: bool, line: Any) -> None:
    """A few rows of one file's metadata."""
    if as_json:
        rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]
        print(json.dumps(rows, indent=2, ensure_ascii=False))
    else:
        for r in df.select(line.alias("x")).collect():
            print(r["x"])


def _text(c: str, otherwise: str = "") -> Any:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", otherwise).otherwise(F.col(c))


def _track_line() -> Any:
    return F.concat(F.col("track_id").cast("string"), F.lit(": "), F.col("type"), F.lit(" "), F.col("codec"), F.lit(" ["), F.col("language"), F.lit("]"), F.when(F.col("name") != "", F.concat(F.lit(" "), F.col("name"))).otherwise(""), F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.format_string(" %dx%d", "width", "height")).otherwise(""), F.when(F.col("channels").isNotNull(), F.format_string(" %dch", "channels")).otherwise(""), F.when(F.col("is_default"), " default").otherwise(""), F.when(F.col("is_forced"), " forced").otherwise(""))


def _tag_rows(m: api.Media) -> DataFrame:
    return m.tags.join(m.simple_tags.where("depth = 0"), ["path", "tag_index"]).select("tag_index", "node", "target_type", "target_id", "name", "value", "language").orderBy("tag_index", "node")


def listing(spark: SparkSession, what: str, path: str, as_json: bool) -> None:
    m = api.open_media(spark, path, payload=False)
    if what == "probe" and as_json:
        # One file's metadata.
        found = [json.loads(r["json"]) for r in api.probe(spark, path).collect()]
        print(json.dumps(found[0] if len(found) == 1 else found, indent=2, ensure_ascii=False))
        return
    if what in ("info", "probe"):
        counts = {n: getattr(m, n).count() for n in ("tracks", "chapters", "attachments", "tags")}
        line = F.concat(F.lit("Title: "), _text("title"), F.lit("\nDuration: "), clock_time(F.col("duration_ms")), F.lit("\nMuxing app: "), F.col("muxing_app"), F.lit("\nWriting app: "), F.col("writing_app"), F.lit("".join(f"\n{k.capitalize()}: {v}" for k, v in counts.items())))
        _show(m.segments.drop("segment_uid", "prev_uid", "next_uid").withColumns({f"n_{k}": F.lit(v) for k, v in counts.items()}), as_json, line)
        if what == "info":
            return
    if what in ("tracks", "probe"):
        _show(m.tracks.drop("codec_private", "header_stripping").orderBy("track_index"), as_json, _track_line())
    if what in ("chapters", "probe"):
        _show(m.chapters.where("depth = 0").drop("segment_uid").orderBy("ordinal"), as_json, F.concat(clock_time(F.col("start_ms")), F.lit(" "), F.col("title")))
    if what in ("attachments", "probe"):
        _show(m.attachments.drop("data").orderBy("att_index"), as_json, F.concat(F.col("id").cast("string"), F.lit(": "), F.col("name"), F.lit(" ("), F.col("mime_type"), F.lit(", "), format_bytes(F.col("size")), F.lit(")")))
    if what in ("tags", "probe"):
        _show(_tag_rows(m), as_json, F.concat(F.lit("["), _text("target_type", "global"), F.lit("] "), F.col("name"), F.lit(" = "), F.col("value"), F.lit(" ("), _text("language", "und"), F.lit(")")))


def _whole(v: Any) -> Decimal | None:
    return Decimal(int(v)) if v else None


def _walk(items: list[dict] | None, below: str) -> Iterator[tuple[int, int, int, int, dict]]:
    """(node, parent node, depth, ordinal, object) of nested lists of objects, a parent before its children."""
    stack = [(-1, 0, i, x) for i, x in reversed(list(enumerate(items or [])))]
    node = 0
    while stack:
        parent, depth, at, x = stack.pop()
        yield node, parent, depth, at, x
        stack += [(node, depth + 1, i, y) for i, y in reversed(list(enumerate(x.get(below) or [])))]
        node += 1


def _patched(patch: dict[str, Any]) -> dict[str, Any]:
    unknown = patch.keys() - PATCH.keys()
    if unknown:
        raise ValueError(f"unknown members: {', '.join(sorted(unknown))}")
    edits: dict[str, Any] = {}
    if patch.get("title") is not None:
        edits["segments"] = lambda df: df.withColumn("title", F.lit(patch["title"]))

    def tracks(df: DataFrame) -> DataFrame:
        for t in patch.get("tracks", []):
            for c in ("language", "name", "is_default", "is_forced"):
                if t.get(c) is not None:
                    df = df.withColumn(c, F.when(F.col("track_id") == t["id"], F.lit(t[c])).otherwise(F.col(c)))
        return df

    def chapters(df: DataFrame) -> DataFrame:
        rows = [(None, node, parent, depth, at, _whole(c.get("id")), c.get("title") or "", c.get("start_ms") or 0, c.get("end_ms") or 0, None) for node, parent, depth, at, c in _walk(patch["chapters"], "sub_chapters")]
        return df.sparkSession.createDataFrame(rows, df.schema)

    def tags(df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame([(None, i, t.get("target_type") or "", _whole(t.get("target_id"))) for i, t in enumerate(patch["tags"])], df.schema)

    def simple_tags(df: DataFrame) -> DataFrame:
        rows = [(None, i, node, parent, depth, s.get("name") or "", s.get("value") or "", base64.b64decode(s["binary"]) if s.get("binary") else None, s.get("language") or "") for i, t in enumerate(patch["tags"]) for node, parent, depth, _, s in _walk(t.get("simple_tags"), "sub_tags")]
        return df.sparkSession.createDataFrame(rows, df.schema)

    if patch.get("tracks"):
        edits["tracks"] = tracks
    if patch.get("chapters") is not None:
        edits["chapters"] = chapters
    if patch.get("tags") is not None:
        edits |= {"tags": tags, "simple_tags": simple_tags}
    return edits


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cuewright", description="Operations on time-coded container files.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("-json", "--json", action="store_true", help="print JSON")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, **options: Any) -> None:
        c = sub.add_parser(name)
        for a in args:
            flags, kw = a if isinstance(a, tuple) else (a, {})
            c.add_argument(flags, **kw)

    for name in ("info", "tracks", "chapters", "attachments", "tags", "probe", "validate"):
        command(name, "file")
    command("compare", "a", "b")
    command("demux", "file", "folder", ("--tracks", {"type": numbers, "default": []}))
    command("mux", "out", ("inputs", {"nargs": "+", "type": track_input}))
    command("remove-track", "file", "out", ("ids", {"type": numbers}))
    command("add-track", "file", ("source", {"type": track_input}), "out", ("--language", {"default": ""}), ("--name", {"default": ""}))
    command("extract-attachment", "file", ("id", {"type": int}), "out")
    command("extract-subtitle", "file", ("id", {"type": int}), "out", ("--format", {"choices": ("srt", "ass", "ssa")}))
    command("edit", "file", "out", ("patch", {"help": "JSON, or - for standard input"}))
    command("edit-inplace", "file", "patch")
    command("edit-title", "file", "out", "title")
    command("edit-track", "file", "out", ("id", {"type": int}), ("--language", {}), ("--name", {}), ("--default", {"choices": ("true", "false")}), ("--forced", {"choices": ("true", "false")}))
    command("merge", "out", ("sources", {"nargs": "+"}))
    command("merge-subtitle", "file", "subtitle", "out", ("--language", {"default": "und"}), ("--name", {"default": ""}), ("--format", {"choices": ("srt", "ass", "ssa")}), ("--merge", {"nargs": "+", "default": [], "help": "sources merged in first"}))
    command("split", "file", "folder", ("--ranges", {"type": spans, "default": []}), ("--pattern", {"default": "part_%03d.mkv"}))
    command("join", "out", ("sources", {"nargs": "+"}))
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    c = args.command
    if c in ("info", "tracks", "chapters", "attachments", "tags", "probe"):
        listing(spark, c, args.file, args.json)
    elif c == "validate":
        found = api.validate(spark, args.file).orderBy("check_id", "message")
        _show(found, args.json, issue_text(F.col("severity"), F.col("message")))
        return int(found.where("severity = 'error'").count() > 0)
    elif c == "compare":
        found = api.compare(spark, args.a, args.b).orderBy("section")
        _show(found, args.json, F.concat(F.lit("["), F.col("type"), F.lit("] "), F.col("section"), F.lit(": "), F.col("detail")))
        return int(found.count() > 0)
    elif c == "demux":
        api.demux(spark, args.file, args.folder, args.tracks)
    elif c == "mux":
        api.mux(spark, args.inputs, args.out)
    elif c == "remove-track":
        api.remove_track(spark, args.file, args.out, args.ids)
    elif c == "add-track":
        api.add_track(spark, args.file, api.TrackInput(args.source.path, args.source.track_id, args.language, args.name), args.out)
    elif c == "extract-attachment":
        api.extract_attachment(spark, args.file, args.id, args.out)
    elif c == "extract-subtitle":
        call = api.extract_ass if api.subtitle_kind(args.out, args.format) == "ass" else api.extract_subtitle
        call(spark, args.file, args.id, args.out)
    elif c in ("edit", "edit-inplace"):
        edits = _patched(json.loads(sys.stdin.read() if args.patch == "-" else args.patch))
        if c == "edit":
            api.edit_metadata(spark, args.file, args.out, **edits)
        else:
            api.edit_in_place(spark, args.file, **edits)
    elif c == "edit-title":
        api.edit_metadata(spark, args.file, args.out, **_patched({"title": args.title}))
    elif c == "edit-track":
        if not api.open_media(spark, args.file).tracks.where(F.col("track_id") == args.id).take(1):
            raise ValueError(f"track {args.id} not found")
        one = {"id": args.id, "language": args.language, "name": args.name, "is_default": None if args.default is None else args.default == "true", "is_forced": None if args.forced is None else args.forced == "true"}
        api.edit_metadata(spark, args.file, args.out, **_patched({"tracks": [one]}))
    elif c == "merge":
        api.merge(spark, args.sources, args.out)
    elif c == "merge-subtitle":
        api.merge_with_subtitles(spark, args.file, args.subtitle, args.out, args.language, args.name, args.merge, format=args.format)
    elif c == "split":
        api.split(spark, args.file, args.folder, args.ranges, args.pattern)
    elif c == "join":
        api.join(spark, args.sources, args.out)
    return 0


def bar(done: int, total: int, width: int = 30) -> str:
    """A progress bar; without a total, what is done."""
    if total <= 0:
        return f"{done} done"
    share = min(1.0, done / total)
    return f"[{'=' * int(share * width):<{width}}] {share * 100:5.1f}% {done}/{total}"


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    show = (lambda done, total: print("\r" + bar(done, total), end="", file=sys.stderr)) if sys.stderr.isatty() else None
    try:
        spark = session()
        with task_progress(spark, show):
            return run(args, spark)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
