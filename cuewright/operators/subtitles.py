"""Subtitle text: parsing of SRT and ASS files, rendering, and subtitle blocks for injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.scalars import ass_time, default_subtitle_end, is_digits_only, parse_dialogue, parse_srt_time_line, srt_time
from cuewright.operators.blocks import numbered
from cuewright.operators.ordered import CHUNK


def parse_srt(files: DataFrame, text: str = "value") -> DataFrame:
    """files (path, text) -> (path, seq, start_ms, end_ms, text) of the cues, seq from 1.

    Lines that are blank or only digits before a time line are skipped, as is
    anything else that is none; a cue's text runs to the next blank line, and
    cues without text are dropped. A byte order mark is passed over.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), r"\r\n?", "\n"), "\n")
    item = "struct<start_ms:bigint,end_ms:bigint,lines:array<string>>"
    blank_state = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("open"))

    def close(acc: Column) -> Column:
        ready = acc.open.isNotNull() & (F.size(acc.open.lines) > 0)
        return F.when(ready, F.concat(acc.done, F.array(acc.open))).otherwise(acc.done)

    def step(acc: Column, line: Column) -> Column:
        times = parse_srt_time_line(line)
        bare = F.trim(line)
        opened = F.struct(times.start_ms.alias("start_ms"), times.end_ms.alias("end_ms"), F.array().cast("array<string>").alias("lines"))
        grown = F.struct(acc.open.start_ms.alias("start_ms"), acc.open.end_ms.alias("end_ms"), F.concat(acc.open.lines, F.array(line)).alias("lines"))
        nothing = F.lit(None).cast(item)
        return (
            F.when(bare == "", F.struct(close(acc).alias("done"), nothing.alias("open")))
            .when(acc.open.isNotNull(), F.struct(acc.done.alias("done"), grown.alias("open")))
            .when(is_digits_only(bare) | times.isNull(), acc)
            .otherwise(F.struct(acc.done.alias("done"), opened.alias("open")))
        )

    cues = F.aggregate(lines, blank_state, step, close)
    found = files.select("path", F.posexplode(cues).alias("pos", "c"))
    return found.select("path", (F.col("pos") + 1).alias("seq"), "c.start_ms", "c.end_ms", F.array_join("c.lines", "\n").alias("text"))


def parse_ass(files: DataFrame, text: str = "value") -> DataFrame:
    """files (path, text) -> (path, seq, start_ms, end_ms, fields) of the Dialogue lines after [Events], seq from 1."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), r"\r\n?", "\n")
    after = F.regexp_replace(body, r"(?is)^.*?(?:^|\n)\s*\[Events\][^\n]*\n(?:(?!\n?Format:)[^\n]*\n)*?Format:[^\n]*\n?", "\u0000")
    events = F.when(after.startswith("\u0000"), F.substring(after, 2, 1 << 30)).otherwise(F.lit(""))
    parsed = F.filter(F.transform(F.split(events, "\n"), lambda x: parse_dialogue(F.trim(x))), lambda x: x.isNotNull())
    return files.select("path", F.posexplode(parsed).alias("pos", "c")).select("path", (F.col("pos") + 1).alias("seq"), "c.start_ms", "c.end_ms", "c.fields")


def ass_header(text: Column) -> Column:
    """Everything up to and with the Format line of [Events]."""
    return F.regexp_extract(F.regexp_replace(text, r"\r\n?", "\n"), r"(?is)^(.*?\[Events\].*?Format:[^\n]*)", 1)


def srt_cue(number: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), srt_time(start_ms), F.lit(" --> "), srt_time(end_ms), F.lit("\n"), text, F.lit("\n\n"))


def ass_dialogue(layer: Column, start_ms: Column, end_ms: Column, fields: Column) -> Column:
    return F.concat(F.lit("Dialogue: "), layer, F.lit(","), ass_time(start_ms), F.lit(","), ass_time(end_ms), F.lit(","), fields)


def render_srt(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """events (path, seq, start_ms, end_ms, text) -> (path, number, cue): numbered texts of the cues with text and times.

    One row a cue, so a file of any length is spread; a writer joins them in the order of number.
    """
    kept = events.where("text is not null and length(text) > 0 and start_ms is not null and end_ms is not null")
    out = numbered(kept, ["path"], "seq", "number", chunk=chunk)
    return out.select("path", "number", srt_cue(F.col("number"), F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("cue"))


def extract_srt(subtitle_blocks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Blocks of a subtitle track (path, block_seq, timecode_ms, text) as cues of the default length."""
    events = subtitle_blocks.select("path", F.col("block_seq").alias("seq"), F.col("timecode_ms").alias("start_ms"), default_subtitle_end(F.col("timecode_ms")).alias("end_ms"), "text")
    return render_srt(events, chunk)


def extract_ass(payloads: DataFrame) -> DataFrame:
    """ASS payload blocks (path, block_seq, timecode_ms, layer, fields) as Dialogue lines of the default length."""
    return payloads.select("path", "block_seq", ass_dialogue(F.col("layer"), F.col("timecode_ms"), default_subtitle_end(F.col("timecode_ms")), F.col("fields")).alias("line"))


def ass_block_payload(order: Column, fields: Column) -> Column:
    """What a Dialogue line becomes as a block: read order, layer 0, the fields."""
    return F.concat(order.cast("string"), F.lit(",0,"), fields)
