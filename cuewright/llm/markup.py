"""Markup residue in text (problem 6).

A text runs through the standard library's streaming HTML parser; its events
are joined by those of scanners for the other dialects (subtitle override
codes, Markdown, wiki, LaTeX) over the character data. A record has markup if
any event but text came. Clean text is written from the same events and keeps
headings, lists, code, formulas and line breaks.

Every event tells how many characters of the source are markup, so each line
of each text, however short, has a ratio of text to tags. It is held as the
share of markup, which is 0 without any and bounded. Smoothed by a Gaussian
along the lines it makes a curve: a record has markup where the curve leaves
zero. Of all curves over the corpus two clusters are made, whose threshold
parts content from dense regions; in these, lines emptied by their markup and
runs of lines that hold nothing but links are no content.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.runs import ass_text
from cuewright.runtime import col, require

SIGMA = 1.0
#: Bins of the corpus's histogram of smoothed shares, from which the threshold is made.
BINS = 1000

#: What a record with markup has at least one of (Java regex, evaluated before Python sees a row). Signs that count at the
#: start of a line only are let through anywhere where a Dialogue line's fields may stand before its Text part; \S stands
#: for the digits of any script.
SUSPECT = r"[<&{}\\*_#|`~=$\[\]>]|''|\+[ \t]|-[ \t]*-[ \t]*-|(?m)^[ \t]*\S{1,3}[.)][ \t]"

_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

# Inline and line patterns of the dialects, tried in this order at each place.
_DIALECTS: list[tuple[str, str]] = [
    ("fence", r"^[ \t]*```[^\n`]*\n(?P<fence_code>.*?)\n?[ \t]*```[ \t]*$"),
    ("mathblock", r"\$\$(?P<mathblock_f>[^$]+)\$\$|\\\[(?P<mathblock_g>.+?)\\\]"),
    ("mathinline", r"\\\((?P<mathinline_f>.+?)\\\)|(?<![\w$\\])\$(?![\s\d$])(?P<mathinline_g>[^$\n]*[^\s$\\])\$(?![\w$])"),
    ("drawing", r"\{[^{}]*\\p[1-9][^{}]*\}(?P<drawing_body>[^{}]*)(?:\{[^{}]*\\p0[^{}]*\}|$)"),
    ("override", r"\{\s*\\[^{}]*\}|\{[A-Za-z]:[^{}\n]*\}"),
    ("wikitable", r"^\{\|.*?^\|\}"),
    ("template", r"\{\{[^{}]*\}\}"),
    ("begin", r"\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]\n]*\])?"),
    ("latexheading", r"\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{(?P<latexheading_t>[^{}]*)\}"),
    ("latexitem", r"\\item\b[ \t]*"),
    ("latexnote", r"\\(?:footnote|cite\w*|label|ref|index|marginpar)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}"),
    ("latexwrap", r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{(?P<latexwrap_t>[^{}]*)\}"),
    ("break", r"[ \t]?\\[Nn](?![a-z]{2})[ \t]?"),
    ("hardspace", r"\\h(?![a-z]{2})"),
    ("latexsign", r"\\[&%$#_{}]"),
    ("latexcommand", r"\\[A-Za-z]+\*?"),
    ("latexquote", r"``(?P<latexquote_t>[^`'\n]+)''"),
    ("heading", r"^(?P<heading_m>#{1,6})[ \t]+(?P<heading_t>[^\n]*?)[ \t]*#*[ \t]*$"),
    ("wikiheading", r"^(?P<wikiheading_m>={2,6})[ \t]*(?P<wikiheading_t>[^=\n]+?)[ \t]*(?P=wikiheading_m)[ \t]*$"),
    ("setext", r"^(?P<setext_t>[^\n]*\S[^\n]*)\n(?P<setext_m>={3,}|-{3,})[ \t]*$"),
    ("image", r"!\[(?P<image_t>[^\]\n]*)\]\([^()\n]*\)"),
    ("link", r"(?<!!)\[(?P<link_t>[^\[\]\n]+)\]\([^()\n]*\)"),
    ("wikifile", r"\[\[(?:File|Image|Category|Datei|Bild|Fichier|Archivo):[^\[\]]*\]\]"),
    ("wikilink", r"\[\[(?:[^\[\]|\n]*\|)?(?P<wikilink_t>[^\[\]|\n]+)\]\]"),
    ("weblink", r"\[https?://[^\s\]]+(?: (?P<weblink_t>[^\]\n]*))?\]"),
    ("code", r"(?<!`)`(?P<code_t>[^`\n]+)`(?!`)"),
    ("strong", r"\*\*(?=\S)(?P<strong_t>[^*\n]+?)(?<=\S)\*\*|(?<!\w)__(?=\S)(?P<strong_u>[^_\n]+?)(?<=\S)__(?!\w)"),
    ("strike", r"~~(?=\S)(?P<strike_t>[^~\n]+?)(?<=\S)~~"),
    ("wikibold", r"'{2,5}(?=[^'\s])(?P<wikibold_t>[^'\n]+?)'{2,5}"),
    ("emphasis", r"(?<![\w*])\*(?=[^\s*])(?P<emphasis_t>[^*\n]*?[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])(?P<emphasis_u>[^_\n]*?[^\s_])_(?![\w_])"),
    ("table", r"^[ \t]*\|[^\n]*\|[ \t]*$"),
    ("bullet", r"^[ \t]*[*+][ \t]+(?=\S)"),
    ("numbered", r"^[ \t]*\d{1,3}[.)][ \t]+(?=\S)"),
    ("quote", r"^[ \t]*>+[ \t]+(?=\S)"),
    ("rule", r"^[ \t]*(?:[*_-][ \t]*){3,}$"),
]
#: Texts of which a dialect's pattern needs at least one.
_NEEDS: dict[str, tuple[str, ...]] = {
    "fence": ("```",), "mathblock": ("$$", "\\["), "mathinline": ("$", "\\("), "drawing": ("\\p",), "override": ("{",), "wikitable": ("{|",), "template": ("{{",),
    "begin": ("\\begin", "\\end"), "latexheading": ("\\",), "latexitem": ("\\item",), "latexnote": ("\\",), "latexwrap": ("\\",), "break": ("\\N", "\\n"), "hardspace": ("\\h",),
    "latexsign": ("\\",), "latexcommand": ("\\",), "latexquote": ("``",), "heading": ("#",), "wikiheading": ("==",), "setext": ("\n===", "\n---"), "image": ("![",), "link": ("](",),
    "wikifile": ("[[",), "wikilink": ("[[",), "weblink": ("[http",), "code": ("`",), "strong": ("**", "__"), "strike": ("~~",), "wikibold": ("''",), "emphasis": ("*", "_"), "table": ("|",),
    "bullet": ("* ", "+ ", "*\t", "+\t"), "numbered": (". ", ") ", ".\t", ")\t"), "quote": (">",), "rule": ("***", "---", "___", "* *", "- -", "_ _"),
}


@lru_cache(maxsize=4096)
def _scanner(names: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in _DIALECTS if name in names), re.M | re.S)


def _dialects_in(text: str) -> tuple[str, ...]:
    return tuple(name for name, needs in _NEEDS.items() if any(n in text for n in needs))


_ASS_COMMENT = re.compile(r"\{[^{}]*\}")
_ASS_BREAK = re.compile(r"\\[Nnh]")
_LIST_LINE = re.compile(r"^[ \t]*\d{1,3}[.)][ \t]+\S", re.M)

_BLOCK_TAGS = {"p", "div", "br", "tr", "table", "ul", "ol", "section", "article", "header", "footer", "nav", "blockquote", "hr", "pre"}
_HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
_HIDDEN_TAGS = {"script", "style", "ref"}
_LINK_TAGS = {"a", "nav", "menu"}

#: Kind, value, and how many characters of the source are markup (0 for plain text only).
Event = tuple[str, str, int]


class _Reader(HTMLParser):
    """Collects tag, comment and text events; character references count only with their semicolon."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.events: list[Event] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.events.append(("open", tag, len(self.get_starttag_text() or "<>")))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.events.append(("single", tag, len(self.get_starttag_text() or "<>")))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("close", tag, len(tag) + 3))

    def handle_comment(self, data: str) -> None:
        self.events.append(("comment", data, len(data) + 3))

    def handle_decl(self, decl: str) -> None:
        self.events.append(("comment", decl, len(decl) + 3))

    def handle_pi(self, data: str) -> None:
        self.events.append(("comment", data, len(data) + 3))

    def unknown_decl(self, data: str) -> None:
        self.events.append(("comment", data, len(data) + 3))

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data, 0))


def _is_reference(name: str) -> bool:
    return name[0] == "#" or name + ";" in html5


#: A tag needs a name that starts with a letter, and an end; other angle brackets are plain signs.
_TAG_LIKE = re.compile(r"<(?=/?[A-Za-z][^<>]*>|!--|\?xml|!DOCTYPE)|<\d\d?:\d\d(?::\d\d)?[.,]\d+>", re.I)


def _html_events(text: str) -> list[Event]:
    """Events of the HTML layer; plain '<' and '&' stay text."""
    if "<" not in text or not _TAG_LIKE.search(text):
        return [("text", text, 0)]
    reader = _Reader()
    # References are left to the dialect stage; plain signs are set aside so that the parser takes them as text.
    held = text.replace("&", "\ue000")
    held = re.sub(r"<\d\d?:\d\d(?::\d\d)?[.,]\d+>", "<t>", held)
    held = re.sub(r"<(?!/?[A-Za-z][^<>]*>|!--|\?xml|!DOCTYPE)", "\ue001", held)
    try:
        reader.feed(held)
        reader.close()
    except AssertionError:  # a malformed declaration
        return [("text", text, 0)]
    merged: list[Event] = []
    for kind, value, signs in reader.events:
        value = value.replace("\ue000", "&").replace("\ue001", "<")
        if kind == "text" and merged and merged[-1][0] == "text":
            merged[-1] = ("text", merged[-1][1] + value, 0)
        else:
            merged.append((kind, value, signs))
    return merged


def _reference(m: re.Match) -> str:
    name = m[1]
    try:
        if name[0] == "#":
            return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))
        return html5.get(name + ";", m[0])
    except (ValueError, OverflowError):
        return "\ufffd"


def _scan_text(text: str, at_line_start: bool, ass: bool) -> Iterator[Event]:
    """Events of the other dialects in character data; the rest as text."""
    at = 0
    names = _dialects_in(text)
    for m in _scanner(names).finditer(text) if names else ():
        kind = next(name for name in names if m.group(name) is not None)
        if m.start() == 0 and not at_line_start and kind in ("heading", "bullet", "numbered", "quote", "table", "wikiheading", "setext", "rule", "fence"):
            continue
        # A lone numbered line is how people speak of places and times; lists have two.
        if kind == "numbered" and len(_LIST_LINE.findall(text)) < 2:
            continue
        if m.start() > at:
            yield from _plain(text[at : m.start()], ass)
        inner = next((v for k, v in m.groupdict().items() if v is not None and k.startswith(kind + "_") and not k.endswith("_m")), "")
        signs = 1 if kind == "latexsign" else m[0].count("|") if kind in ("table", "wikitable") else max(1, len(m[0]) - len(inner))
        if kind in ("heading", "wikiheading"):
            yield kind, m.group(kind + "_m") + " " + inner, signs
        else:
            yield kind, m[0] if kind in ("table", "wikitable", "latexsign") else inner, signs
        at = m.end()
    if at < len(text):
        yield from _plain(text[at:], ass)


def _plain(text: str, ass: bool) -> Iterator[Event]:
    at = 0
    if ass and "{" in text:
        for m in _ASS_COMMENT.finditer(text):
            if m.start() > at:
                yield from _plain(text[at : m.start()], False)
            yield "comment", m[0], len(m[0])
            at = m.end()
        text = text[at:]
        at = 0
    if "&" in text:
        for m in _ENTITY.finditer(text):
            if not _is_reference(m[1]):
                continue
            if m.start() > at:
                yield "text", text[at : m.start()], 0
            yield "reference", _reference(m), len(m[0]) - 1
            at = m.end()
    if at < len(text):
        yield "text", text[at:], 0


def markup_events(text: str, ass: bool = False) -> Iterator[Event]:
    """(kind, value, markup characters) of the parts of a text in order; kind 'text' is plain.

    ass: the text is of a Dialogue line, where \\N breaks the line and braces comment.
    """
    fresh = True
    body = text
    if ass and _ASS_BREAK.search(text):
        # Line patterns of the other dialects see the breaks that are shown.
        body = _ASS_BREAK.sub(lambda m: "\n" if m[0] == "\\N" else " ", text)
        yield "shown", "", len(_ASS_BREAK.findall(text)) * 2
    for kind, value, signs in _html_events(body):
        if kind != "text":
            yield kind, value, signs
            fresh = fresh or value in _BLOCK_TAGS
            continue
        yield from _scan_text(value, fresh, ass)
        fresh = value.endswith("\n")


def smoothed(ratios: Sequence[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with the kernel cut at three sigma and renormed at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for d, w in zip(range(-reach, reach + 1), kernel):
            if 0 <= i + d < len(ratios):
                total += w * ratios[i + d]
                weight += w
        out.append(total / weight)
    return out


@dataclass(slots=True)
class Line:
    """A line as it reads without markup, with what stood in it."""

    text: str
    #: Characters of markup in it and since the line before.
    signs: int
    #: Headings, list items, code, formulas and table rows keep their place in any region.
    fixed: bool
    #: Characters of text inside links and menus.
    linked: int

    @property
    def share(self) -> float:
        return self.signs / (self.signs + len(self.text.strip())) if self.signs else 0.0


def curve(lines: Sequence[Line]) -> list[float]:
    """The smoothed share of markup along the lines; exactly 0 away from any. Blank lines take no part and have 0."""
    at = [i for i, x in enumerate(lines) if x.signs or x.text.strip()]
    out = [0.0] * len(lines)
    for i, y in zip(at, smoothed([lines[i].share for i in at])):
        out[i] = y
    return out


def has_markup(text: str | None, ass: bool = False) -> bool:
    """Whether the curve leaves zero, as it does around any markup event; null and blank texts have none."""
    return bool(text) and any(y > 0.0 for y in curve(read_lines(text, ass)))


def two_clusters(counts: Sequence[float]) -> float:
    """The threshold between two clusters of a histogram over [0, 1] (one-dimensional 2-means from its ends)."""
    at = [(i / (len(counts) - 1), n) for i, n in enumerate(counts) if n] if len(counts) > 1 else []
    if not at:
        return 0.5
    low, high = at[0][0], at[-1][0]
    for _ in range(100):
        cut = (low + high) / 2
        below, above = [x for x in at if x[0] <= cut], [x for x in at if x[0] > cut]
        if not below or not above:
            break
        means = tuple(sum(x * n for x, n in side) / sum(n for _, n in side) for side in (below, above))
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def _content(lines: Sequence[Line], cut: float) -> list[str]:
    """Lines of the content regions.

    In dense regions (the curve is above the cut) a line goes if its markup
    was all it held, or if it and the next or last line with text hold nothing
    but links. Where no line with text lies outside the dense regions, only
    emptied lines go.
    """
    dense = [y > cut for y in curve(lines)]
    full = [i for i, x in enumerate(lines) if x.text.strip()]
    bare = [not lines[i].fixed and lines[i].linked >= len(lines[i].text.strip()) for i in full]
    runs = {i for n, i in enumerate(full) if bare[n] and (bare[n - 1 : n] == [True] or bare[n + 1 : n + 2] == [True])}
    content = any(not dense[i] for i in full)
    gone = lambda i, x: dense[i] and not x.fixed and ((x.signs and not x.text.strip()) or (content and i in runs))
    return [x.text for i, x in enumerate(lines) if not gone(i, x)]


def clean_text(text: str | None, ass: bool = False, cut: float = 0.5) -> str | None:
    """The text without markup, with headings, lists, code, formulas and line breaks kept.

    Headings come as '# title', list items as '- item', code in backticks,
    formulas in dollar signs, table rows as their cells between bars. Null is
    null; a text without markup comes back as it is. cut is the threshold of
    dense regions, see markup_threshold().
    """
    if not text:
        return text
    lines = read_lines(text, ass)
    if not any(x.signs for x in lines):
        return text
    return "\n".join(re.sub(r"[ \t]{2,}", " ", x).strip() for x in _content(lines, cut)).strip("\n")


def read_lines(text: str, ass: bool = False) -> list[Line]:
    """The lines of a text, written from its events."""
    lines: list[Line] = []
    now: list[str] = []
    signs = linked = links = 0
    fixed = False
    hidden: list[str] = []

    def end() -> None:
        nonlocal now, signs, linked, fixed
        lines.append(Line("".join(now), signs, fixed, linked))
        now, signs, linked, fixed = [], 0, 0, False

    def put(value: str, inside: bool = False) -> None:
        nonlocal linked
        now.append(value)
        linked += len(value.strip()) if inside or links else 0

    def write(value: str) -> None:
        head, *more = value.split("\n")
        put(head)
        for x in more:
            end()
            put(x)

    def block() -> None:
        if "".join(now).strip():
            end()
        else:
            now.clear()

    def fix(value: str) -> None:
        nonlocal fixed
        now.append(value)
        fixed = True

    for kind, value, size in markup_events(text, ass):
        signs += size
        if hidden:
            if kind == "close" and value == hidden[-1]:
                hidden.pop()
            continue
        if kind == "text":
            write(value)
        elif kind == "reference":
            write("\n" if value == "\n" else value.replace("\xa0", " "))
        elif kind in ("open", "single", "close"):
            if value in _LINK_TAGS and kind != "single":
                links = max(0, links + (1 if kind == "open" else -1))
            if kind == "open" and value in _HIDDEN_TAGS:
                hidden.append(value)
            elif value in _HEADINGS:
                if kind == "open":
                    block()
                    fix(_HEADINGS[value] + " ")
                elif kind == "close":
                    block()
            elif value == "li":
                if kind == "open":
                    block()
                    fix("- ")
                else:
                    block()
            elif value in ("code", "tt"):
                fix("`")
            elif value == "br":
                end()
            elif value in _BLOCK_TAGS:
                block()
        elif kind == "break":
            end()
        elif kind == "hardspace":
            now.append(" ")
        elif kind in ("heading", "wikiheading", "setext", "latexheading"):
            block()
            fix(value if kind == "heading" else "# " + value.lstrip("= ") if kind == "wikiheading" else "# " + value)
            if kind == "latexheading":
                end()
        elif kind in ("bullet", "numbered", "latexitem"):
            block()
            fix("- ")
        elif kind == "fence":
            fix("```\n" + value + "\n```")
        elif kind == "code":
            fix("`" + value + "`")
        elif kind in ("mathblock", "mathinline"):
            fix("$" + value.strip() + "$")
        elif kind == "table":
            cells = [c.strip() for c in value.strip().strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                fix(" | ".join(cells))
        elif kind == "wikitable":
            for row in value.split("\n")[1:-1]:
                if row.startswith("|") and not row.startswith("|-"):
                    fix(" | ".join(c.strip() for c in row.strip("|").split("||")))
                    end()
        elif kind == "latexsign":
            now.append(value[1:])
        elif kind == "latexquote":
            now.append("“" + value + "”")
        elif kind in ("link", "wikilink", "weblink", "strong", "strike", "wikibold", "emphasis", "latexwrap"):
            put(clean_text(value) or "", inside=kind in ("link", "wikilink", "weblink"))
        # Comments, overrides, drawings, templates, notes, images, quotes, rules and environments leave their size only.
    end()
    return lines


def _rows(df: DataFrame, keys: Sequence[str], text: str, ass: str | None) -> tuple[DataFrame, list[str], str]:
    require(df, *keys, text, *([ass] if ass else []))
    ks = [f"k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{a} {df.schema[k].dataType.simpleString()}" for k, a in zip(keys, ks))
    return df.select(*[col(k).alias(a) for k, a in zip(keys, ks)], col(text).alias("t"), (col(ass) if ass else F.lit(False)).alias("ass")), ks, kinds


def find_markup(df: DataFrame, keys: Sequence[str], text: str, ass: str | None = None) -> DataFrame:
    """Distinct keys of the rows whose text has markup.

    Null, blank and (ASS) cut-short texts have none. ass names a boolean
    column: where true, text holds Dialogue fields and only their Text part is
    looked at. Null keys are keys like others; repeated rows give one row. An
    empty table gives none; extra columns are ignored.
    """
    rows, ks, kinds = _rows(df, keys, text, ass)
    nk = len(ks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for t, a in zip(batch.column(nk).to_pylist(), batch.column(nk + 1).to_pylist()):
                flags.append(has_markup(ass_text(t) if a else t, bool(a)))
            yield pa.RecordBatch.from_arrays(batch.columns[:nk], ks).filter(pa.array(flags, pa.bool_()))

    found = rows.where(F.col("t").rlike(SUSPECT)).mapInArrow(run, kinds)
    return found.distinct().select(*[F.col(a).alias(k) for k, a in zip(keys, ks)])


def markup_threshold(df: DataFrame, text: str, ass: str | None = None) -> float:
    """The threshold between content and dense regions: two clusters of the curves of all texts with markup.

    Every row counts; a histogram of BINS + 1 numbers reaches the driver.
    """
    rows, _, _ = _rows(df, [], text, ass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * (BINS + 1)
        for batch in batches:
            for t, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = ass_text(t) if a else t
                lines = read_lines(body, bool(a)) if body else []
                if any(x.signs for x in lines):
                    for y in curve(lines):
                        counts[round(y * BINS)] += 1
        used = [i for i, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([counts[i] for i in used], pa.int64())], ["bin", "n"])

    found = rows.where(F.col("t").rlike(SUSPECT)).mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = [0] * (BINS + 1)
    for r in found:
        counts[r["bin"]] = r["n"]
    return two_clusters(counts)


def strip_markup(df: DataFrame, keys: Sequence[str], text: str, ass: str | None = None, cut: float | None = None) -> DataFrame:
    """keys + (clean_text, had_markup) for every row of df, repeated ones included.

    Null text stays null; for ASS the Text part is cleaned (null if cut short).
    cut is the threshold of dense regions; that of the whole of df if None. Null
    keys are keys like others, an empty table gives no rows, extra columns are
    ignored.
    """
    rows, ks, kinds = _rows(df, keys, text, ass)
    nk = len(ks)
    at = markup_threshold(df, text, ass) if cut is None else cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, had = [], []
            for t, a in zip(batch.column(nk).to_pylist(), batch.column(nk + 1).to_pylist()):
                body = ass_text(t) if a else t
                had.append(has_markup(body, bool(a)))
                out.append(clean_text(body, bool(a), at) if had[-1] else body)
            yield pa.RecordBatch.from_arrays([*batch.columns[:nk], pa.array(out, pa.string()), pa.array(had, pa.bool_())], [*ks, "clean_text", "had_markup"])

    return rows.mapInArrow(run, f"{kinds}, clean_text string, had_markup boolean").select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "clean_text", "had_markup")
