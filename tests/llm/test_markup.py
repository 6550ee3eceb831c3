import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuewright.llm.markup import SUSPECT, clean_text, curve, find_markup, has_markup, markup_events, markup_threshold, read_lines, smoothed, strip_markup, two_clusters

MARKED = [
    "<i>Yes</i>", "<font color=#fff>x", "a<br/>b", "x<!-- y -->", "&nbsp;x", "&#8217;", "&lt;b&gt;", "{\\an8}x", "{y:i}x", "**a** b", "a _b_ c", "~~a~~", "`x = 1`", "[a](b)", "![a](b.png)",
    "# Head\ntext", "Head\n====\ntext", "* a\n* b", "1. a\n2. b", "> quoted", "|a|b|\n|---|---|", "```\ncode\n```", "== Head ==\nx", "[[a|b]]", "{{note|x}}", "''a''", "{| class=t\n| a || b\n|}",
    "\\textbf{a}", "\\section{a} b", "\\begin{itemize}\n\\item a\n\\end{itemize}", "a \\& b", "$E = m$", "$$x$$", "\\(x\\)", "\\[x\\]", "``a''", "\\footnote{x}a", "a \\h b", "a\\Nb", "<v Ann>Yes", "<ref>x</ref>",
]
PLAIN = ["", " ", None, "plain", "- Who?\n- Me.", "[door slams]", "(whispers) x", "♪ la ♪", "Q&A & more", "I <3 you", "a < 3 and b > 2", "395 > 260?", "#12 here", "*238# dial", "3*4*2", "a == b", "$371, the attic is $5.", "cellar_anchor_v2", "either/or", "2. place", "100 %", "AT&T; then", "x ~ y"]


@pytest.mark.parametrize("text", MARKED)
def test_marked(text, spark):
    assert has_markup(text)


def test_plain_and_the_first_filter(spark):
    for text in PLAIN:
        assert not has_markup(text), text
        assert clean_text(text) == text
    kept = spark.createDataFrame([(t,) for t in MARKED], "t string")
    assert kept.where(F.col("t").rlike(SUSPECT)).count() == len(MARKED)


@pytest.mark.parametrize(
    ("text", "ass", "want"),
    [
        ("<h2>Head</h2>Body <b>bold</b>", False, "## Head\nBody bold"),
        ("\\section{Head} Body", False, "# Head\nBody"),
        ("== Head ==\nBody", False, "# Head\nBody"),
        ("Head\n====\nBody", False, "# Head\nBody"),
        ("x\n* a\n* b", False, "x\n- a\n- b"),
        ("<ul><li>a</li><li>b</li></ul>", False, "- a\n- b"),
        ("x\n```\na_b = **c**\n```", False, "x\n```\na_b = **c**\n```"),
        ("so \\(x_{1}\\) is", False, "so $x_{1}$ is"),
        ("{\\i1}one\\Ntwo{\\i0}", True, "one\ntwo"),
        ("{\\p1}m 0 0 l 1 1{\\p0}", True, ""),
        ("a&nbsp;b &lt;i&gt;", False, "a b <i>"),
        ("see [here](x) and [[Big|small]]", False, "see here and small"),
        ("The \\nword", True, "The word"),
    ],
)
def test_clean(text, ass, want):
    assert clean_text(text, ass) == want


def test_page_keeps_content_and_drops_link_lines():
    menu = "".join(f'<div><a href="/{i}"><span>m{i}</span></a></div>\n' for i in range(14))
    body = "".join(f"<p>This is the long sentence number {i} of the article, and it goes on for a while.</p>\n" for i in range(14))
    clean = clean_text(menu + body)
    assert all(f"number {i} of" in clean for i in range(14)) and "m3" not in clean.split()


@pytest.mark.parametrize("n", [2, 3, 5, 11, 40])
def test_regions_of_texts_of_any_length(n):
    menu = "\n".join(f'<a href="/{i}">m{i}</a>' for i in range(n))
    body = "\n".join(f"This is the <i>long</i> sentence number {i} of the article, and it goes on for a while." for i in range(3))
    assert clean_text(f"{menu}\n\n\n{body}").startswith("This is the long sentence number 0") and clean_text(f"{body}\n\n\n{menu}").endswith("for a while.")
    # Links alone are the content; so is one among words; what keeps its place stays in any region.
    assert clean_text(menu) == "\n".join(f"m{i}" for i in range(n))
    assert clean_text(f'{body}\n\n\n<a href="/x">here</a>').endswith("here")
    listed = "\n".join(f'<li><a href="/{i}">m{i}</a></li>' for i in range(n))
    assert clean_text(f"{body}\n\n\n{listed}").count("- m") == n


def test_emptied_lines_go_and_blank_ones_stay():
    assert clean_text("{\\an8}{\\fad(1,1)}\nWords") == "Words" and clean_text("<i>Words</i>\n\nmore") == "Words\n\nmore"
    assert clean_text("Words\n|---|---|\nmore", cut=0.4) == "Words\nmore"


def test_threshold_lies_between_the_clusters(spark):
    assert two_clusters([0] * 11) == two_clusters([]) == 0.5
    assert two_clusters([0, 100, 0, 0, 0, 0, 0, 0, 0, 10, 0]) == pytest.approx(0.5)
    assert two_clusters([9, 1, 0, 0, 0, 0, 0, 0, 0, 0, 5]) == pytest.approx((0.01 + 1.0) / 2)
    rows = [("<b>" + "word " * 50 + "</b>", False)] * 40 + [("<a href='x'>y</a>", False)] * 3 + [("plain", False), (None, True), ("cut,short", True)]
    df = spark.createDataFrame(rows, "t string, a boolean")
    curves = [y for t, _ in rows[:43] for y in curve(read_lines(t))]
    cut = markup_threshold(df.repartition(5), "t", "a")
    assert max(curves[:40]) < cut < min(curves[40:]) and markup_threshold(df.limit(0), "t") == 0.5


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1 \n\t-*_#`~=|<>{}[]()\\&;:$'!/.Np+", max_size=24), st.booleans())
def test_the_curve_leaves_zero_at_any_event_and_the_filter_keeps_it(text, ass):
    events = any(kind != "text" for kind, _, _ in markup_events(text, ass))
    assert has_markup(text, ass) == events
    if events:
        import re

        assert re.search(SUSPECT.replace("(?m)", ""), text, re.M)


def test_smoothing_is_the_plain_weighted_mean():
    assert smoothed([1.0] * 5) == pytest.approx([1.0] * 5) and smoothed([0, 0, 9, 0, 0])[2] == max(smoothed([0, 0, 9, 0, 0]))


def test_rows(spark):
    rows = [("a", 1, "<i>x</i>", False), ("a", 1, "<i>x</i>", False), ("a", 2, "x", False), ("b", 1, "Default,,0,0,0,,{\\an8}x", True), ("b", 2, "Default,{x},0", True), ("b", 3, None, True), (None, None, "**x**", False), ("c", 1, "<b>" + "long " * 100_000, False)]
    df = spark.createDataFrame(rows, "p string, n int, t string, a boolean").selectExpr("*", "1 as k0", "2 as ass")
    assert {tuple(r) for r in find_markup(df, ["p", "n"], "t", "a").collect()} == {("a", 1), ("b", 1), (None, None), ("c", 1)}
    assert find_markup(df, ["p", "n"], "t", "a").count() == 4
    clean = strip_markup(df, ["p", "n"], "t", "a")
    assert clean.count() == 8 and clean.where("p = 'b' and n = 1").first()["clean_text"] == "x"
    assert find_markup(df.limit(0), ["p"], "t").count() == 0


def test_first_filter_lets_everything_through_that_the_parser_finds(spark):
    plain = ["Opening words\n---\nThe mill is shut.", "Head\n-----", "---", "- - -", "a\n- - - -\nb", "  -----  ", "+ a\n+ b", "١. a\n٢. b"]
    ass = [f"Default,,0,0,0,,{t}" for t in ("---", "- - -", "+ a", "1. a\n2. b")]
    rows = [(t, False) for t in plain] + [(t, True) for t in ass] + [("- Who?\n- Me.", False), ("well -- no", False), ("Mr. X\nNo. 2", False)]
    df = spark.createDataFrame(rows, "t string, a boolean")
    found = {r["t"] for r in find_markup(df, ["t"], "t", "a").collect()}
    assert found == {*plain, *ass} == {r["t"] for r in strip_markup(df, ["t"], "t", "a").where("had_markup").collect()}
