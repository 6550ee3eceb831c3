from cuewright.llm.canonical import grams, map_values, normal, readings

REF = [("eng", "eng", "en", "English", "English"), ("deu", "ger", "de", "German", "Deutsch"), ("fra", "fre", "fr", "French", "Français"), ("ces", "cze", "cs", "Czech", "Čeština"), ("cat", "cat", "ca", "Catalan", "Català"), ("rum", "ron", "ro", "Romanian", "Română"), ("slk", "slo", "sk", "Slovak", "Slovenčina"), ("slv", "slv", "sl", "Slovenian", "Slovenščina"), ("vie", "vie", "vi", "Vietnamese", "Tiếng Việt"), ("lav", "lav", "lv", "Latvian", "Latviešu")]
WANT = {
    "English": "eng", "ENGLISH ": "eng", "englsih": "eng", "Engl.": "eng", "en-AU": "eng", "fra-CA": "fra", "fr_CA": "fra", "French (CA)": "fra", "[German]": "deu", "audio: German": "deu",
    "lang=cs": "ces", "ger": "deu", "Czech (CS)": "ces", "Română".replace("̂", ""): "rum", "E​nglish": "eng", "British English": "eng", "German, SDH": "deu", "eng/en": "eng", "Français (French)": "fra",
    "Slovenian": "slv", "slovaak": "slk", "tiếng việt": "vie", "de dialogue": "deu", "deu.": "deu", "Latviešu": "lav", "Latin American English": "eng", "Francais": "fra", "latviesu": "lav", "Tieng Viet": "vie", "slovenscina": "slv", "slovencina": "slk",
    "Moorspeak": "none", "silent film": "none", "und": "none", "": "none", " ": "none", "???": "none", "Surround 5.1": "none", "music & effects": "none", "as on disc": "none", "e": "none",
}


def test_values(spark):
    ref = spark.createDataFrame(REF, "a string, b string, c string, d string, e string")
    values = spark.createDataFrame([(v, 1, 2) for v in [*WANT, *WANT, None]], "v string, code int, score int")
    got = {r["v"]: r["code"] for r in map_values(values, "v", ref, "a", list("abcde")).collect()}
    assert got == WANT | {None: "none"}


def test_empty_sides(spark):
    ref = spark.createDataFrame(REF, "a string, b string, c string, d string, e string")
    values = spark.createDataFrame([("English",), ("x" * 50_000,)], "v string")
    assert {r["code"] for r in map_values(values, "v", ref.limit(0), "a", ["d"]).collect()} == {"none"}
    assert map_values(values.limit(0), "v", ref, "a", ["d"]).count() == 0
    assert {r["v"][:7]: r["code"] for r in map_values(values, "v", ref, "a", ["d"]).collect()} == {"English": "eng", "xxxxxxx": "none"}


def test_forms():
    assert normal(" É​. ") == "é" and readings("") == [] and readings("Eng.")[0] == (0, "eng", True, True)
    assert "\x02e" in grams("engl", True) and "l\x03" not in grams("engl", True) and "l\x03" in grams("engl", False) and grams("eng", False) == ["\x02eng\x03"]


def test_the_prefix_loses_no_near_term(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from cuewright.llm import canonical

    rnd = random.Random(5)
    syllables = ["ba", "ri", "lon", "tes", "mar", "ka", "vo", "din"]
    terms = sorted({"".join(rnd.choice(syllables) for _ in range(rnd.randrange(2, 5))) for _ in range(120)})
    typed = ["".join(c for c in rnd.choice(terms) if rnd.random() > 0.12) + rnd.choice(["", "x", "a"]) for _ in range(150)]
    ref = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(terms)], "code string, name string")
    df = Counter(g for t in terms for g in grams(t, False))
    weight = lambda g: math.log(1 + len(terms) / df[g]) if g in df else math.log(1 + len(terms))

    def want(v):
        form, best = normal(v), {}
        for i, t in enumerate(terms):
            a, b = set(grams(form, False)), set(grams(t, False))
            score = sum(weight(g) ** 2 for g in a & b) / math.sqrt(sum(weight(g) ** 2 for g in a) * sum(weight(g) ** 2 for g in b))
            best[f"c{i}"] = 1.0 if form == t else min(score, 0.999) if len(form) > 3 and score >= 0.3 else 0.0
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))
        return top[0][0] if top[0][1] > 0 and top[0][1] - top[1][1] >= 0.03 else "none"

    for hot in (10_000, 2):
        monkeypatch.setattr(canonical, "HOT", hot)
        got = {r["v"]: r["code"] for r in map_values(spark.createDataFrame([(v,) for v in typed], "v string"), "v", ref, "code", ["name"]).collect()}
        assert got == {v: want(v) for v in typed}
