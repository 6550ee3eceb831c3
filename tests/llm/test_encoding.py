import random

import pytest

from cuewright.llm.encoding import CHAINS, LEAST_SLOTS, MOST_SLOTS, garbled_records, table_size, undo_chain, untrusted

WORDS = {
    "de": "Straße Brücke früh größere Mädchen zurück schließt täglich Käse hören".split(),
    "fr": "château forêt déjà élève leçon très noël été rivière côté".split(),
    "cs": "žádný večer příběh světlo kůň řeka věž štěstí dům čaj".split(),
    "ru": "дорога сестра письмо вечер старый мальчик город снег дверь реку".split(),
    "el": "νύχτα μητέρα θάλασσα τραγούδι δρόμος φωτιά σπίτι παιδί γράμμα ξανά".split(),
    "ja": "手紙を読んで 古い橋が 雪が降る 誰もいない 待っていた もう一度 聞こえる".split(),
}
GARBLE = {
    "de": [("utf-8", "latin-1"), ("utf-8", "cp850"), ("utf-8", "mac_roman")],
    "fr": [("utf-8", "latin-1"), ("utf-8", "cp437")],
    "cs": [("cp1250", "latin-1"), ("utf-8", "latin-1")],
    "ru": [("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("utf-8", "cp1251")],
    "el": [("cp1253", "latin-1"), ("utf-8", "latin-1")],
    "ja": [("euc_jp", "latin-1"), ("cp932", "latin-1")],
}


def corpus(seed=1, n=1500):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        text = " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randrange(3, 8)))
        bad = None
        if rnd.random() < 0.06:
            true, wrong = rnd.choice(GARBLE[lang])
            try:
                bad = text.encode(true).decode(wrong)
            except UnicodeError:
                bad = None
        rows.append((rnd.choice(["a", "b", "c"]), i, bad or text, text if bad else None))
    return rows


def test_chains_undo_what_was_done():
    for word in ("Straße", "дорога", "手紙"):
        for chain in CHAINS[:40]:
            try:
                bad = word
                for wrong, right in reversed(chain):
                    bad = bad.encode(right).decode(wrong)
            except (UnicodeError, LookupError):
                continue
            if bad != word and chain[0][1] == "utf-8":
                assert undo_chain(bad, chain) == word
    assert undo_chain("Straße", (("cp1252", "utf-8"),)) is None
    assert untrusted("StraÃŸe") and untrusted("Ksi¹¿ka") and untrusted("m\x80x") and not any(untrusted(w) for ws in WORDS.values() for w in ws)


def test_found_and_restored(spark):
    rows = corpus()
    extra = [("a", 5000, "W�hlt gr��ere zur�ck", None), ("a", 5001, None, None), ("a", 5002, "", None), ("b", 5003, "plain ASCII words", None), ("b", 5004, "NÃO VOLTES à MÃE", None), (None, 5005, "Straße " * 20_000, None)]
    df = spark.createDataFrame([*rows, *rows[:50], *extra], "src string, i int, text string, good string").selectExpr("*", "'f' as fld", "1 as chain", "2 as pool", "3 as k0")
    got = garbled_records(df, ["src", "i"], "text", "src", "fld", repaired=True).collect()
    assert len(got) == len({(r["src"], r["i"]) for r in got})
    found = {r["i"]: r for r in got}
    bad = {i: good for _, i, _, good in rows if good is not None}
    assert 5000 in found and found[5000]["restored_text"] is None and not {5001, 5002, 5003, 5005} & set(found)
    hit = len(bad.keys() & found.keys())
    assert hit / len(bad) > 0.95 and len(found.keys() - bad.keys() - {5000, 5004}) <= 3
    assert sum(found[i]["restored_text"] == g for i, g in bad.items() if i in found) / len(bad) > 0.85


def test_empty(spark):
    df = spark.createDataFrame([("a", 1, "x", "f")], "src string, i int, text string, fld string")
    assert garbled_records(df.limit(0), ["i"], "text", "src", "fld").count() == 0
    assert garbled_records(df, ["i"], "text", "src", "fld").count() == 0


def test_digits_tags_and_latin_words_in_text_of_several_bytes_a_character(spark):
    wide = [("euc_jp", "第3章"), ("cp932", "第3章"), ("euc_jp", "<i>手紙を読んで</i>"), ("cp932", "<i>古い橋が</i>"), ("gbk", "第12章：<b>雪</b>"), ("big5", "(OK)雪"), ("euc_kr", "제3장"), ("euc_jp", "「OK」と聞こえる"), ("euc_jp", "TVを見ていた")]
    for right, text in wide:
        assert undo_chain(text.encode(right).decode("latin-1"), (("latin-1", right),)) == text
    for word in ("Fräulein", "süß", "NÃO", "préférée", "l’élève", "l'élève", "größer", "StraÃ\x9fe"):
        assert all(undo_chain(word, ((w, t),)) is None for w in ("latin-1", "cp1252") for t in ("euc_jp", "cp932", "gbk", "big5", "euc_kr")), word
    marked = ["第3章", "<i>手紙を読んで</i>", "<i>雪が降る</i>", "もう一度2", "第4章<b>古い橋が</b>"]
    rows = [*[r[:3] for r in corpus(2)], *[("d", 6000 + i, t) for i, t in enumerate(marked * 10)]]
    bad = {7000 + 10 * i + j: (t, t.encode(right).decode("latin-1")) for i, t in enumerate(marked) for j, right in enumerate(("euc_jp", "cp932"))}
    df = spark.createDataFrame([*rows, *[("d", i, b) for i, (_, b) in bad.items()]], "src string, i int, text string").selectExpr("*", "'f' as fld")
    got = {r["i"]: r["restored_text"] for r in garbled_records(df, ["src", "i"], "text", "src", "fld", repaired=True).collect() if r["i"] >= 6000}
    assert got == {i: t for i, (t, _) in bad.items()}


def test_a_lost_character_that_was_misread_again_is_loss(spark):
    lost = ["Caf�".encode().decode(w) for w in ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp1250")]
    lost += [x.encode().decode("cp1252") for x in lost[:1]] + ["Caf�".encode().decode("cp1251").encode().decode("cp1251")]
    rows = [*[("a", i, t) for i, t in enumerate(lost)], ("a", 100, "¿Qué?"), ("a", 101, "ï"), ("a", 102, "я ПН"), ("a", 103, "Café ½")]
    df = spark.createDataFrame([*rows, *[("a", 5000 + r[1], r[2]) for r in corpus(3) if r[3] is None]], "src string, i int, text string").selectExpr("*", "'f' as fld")
    got = {r["i"]: (r["chain"], r["restored_text"]) for r in garbled_records(df, ["i"], "text", "src", "fld", repaired=True).where("i < 200").collect()}
    assert got == {i: ("loss", None) for i in range(len(lost))}


def test_texts_of_one_key_are_judged_each(spark):
    rows = [("a", i, t, "o", "f") for i, t in corpus_texts()] + [("k", 1, "Straße und Brücke", "o", "f"), ("k", 1, "Straße und Brücke".encode().decode("latin-1"), "o", "f")] * 2
    df = spark.createDataFrame(rows, "p string, n int, t string, s string, f string").repartition(5)
    assert [tuple(r)[:2] for r in garbled_records(df, ["p", "n"], "t", "s", "f").where("p = 'k'").collect()] == [("k", 1)]
    assert [r["restored_text"] for r in garbled_records(df, ["p", "n"], "t", "s", "f", repaired=True).where("p = 'k'").collect()] == ["Straße und Brücke"]


def corpus_texts():
    rnd = random.Random(8)
    return [(i, " ".join(rnd.choice(WORDS["de"]) for _ in range(5))) for i in range(400)]


def test_the_table_grows_with_the_pieces():
    assert table_size(1) == LEAST_SLOTS and table_size(10**9) == MOST_SLOTS and table_size(50_000) == 1 << 20
