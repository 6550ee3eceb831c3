import os
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from cuewright.llm.tokens import AT_ONCE, MOST, TOKENIZER_FOLDER, VOCABULARY, Codec, cuts, cuts_in_turn, encode_corpus, rolling_hash

PATH = f"{TOKENIZER_FOLDER}/{VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


def test_joins_of_random_halves():
    codec, rnd = Codec.of(PATH), random.Random(2)
    signs = "ab cd  '\n\t1é中 .,!s' re　\xa0́🙂"
    for _ in range(4000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(2, 50)))
        at = rnd.randrange(1, len(text))
        assert codec.join(codec.encode(text[:at]), codec.encode(text[at:])) == codec.encode(text)


def test_rolling_hash_is_the_plain_sum():
    points = np.array([random.Random(3).randrange(1 << 20) for _ in range(200)], dtype=np.uint32)
    base = 0x9E3779B97F4A7C15
    for i, h in enumerate(rolling_hash(points)):
        assert int(h) == sum((int(points[i - k]) + 1) * pow(base, k, 1 << 64) for k in range(min(16, i + 1))) % (1 << 64)
    assert len(rolling_hash(points[:3])) == 3 and len(rolling_hash(points[:0])) == 0


def hard_texts():
    rnd = random.Random(7)
    words = ["harbour", "the", "of", "Zoë’s", "120", "(Applause.)", "中文文本没有空格", "—"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 400))) for _ in range(60)]
    out += ["a" * 9000, "ab" * 7000, " " * 5000, "\n\n  x" * 3000, "中" * 6000, "x　 y " * 900, "<|endoftext|> ordinary", "🙂" * 3000, "it's " * 2000, "\x1c a\x1d b " * 700]
    return out


def test_cuts_cover_the_text():
    texts = hard_texts()
    for t, (ends, safe) in zip(texts, cuts(texts)):
        assert ends[-1] == len(t) and ends == sorted(set(ends)) and len(safe) == len(ends) and safe[-1]
        assert max(b - a for a, b in zip([0, *ends], ends)) <= MOST
    assert cuts(["", ""]) == [([], []), ([], [])] and cuts([]) == []


def test_cuts_depend_on_content():
    shared = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    (a, _), (b, _) = cuts([shared, "Another beginning of this text. " + shared])
    pieces = lambda t, ends: {t[x:y] for x, y in zip([0, *ends], ends)}
    assert len(pieces(shared, a) & pieces("Another beginning of this text. " + shared, b)) > 0.8 * len(a)


def test_corpus_against_the_tokenizer(spark):
    tok = Tokenizer.from_file(f"{TOKENIZER_FOLDER}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    texts = hard_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, "no key"), (3, texts[3]), (4, "another text of one key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h1", "2 as pos", "3 as ids", "4 as `key`")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode_corpus(df, "doc_id", "text").collect()), key=str)
    want = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in set(rows)), key=str)
    assert got == want
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_texts_cut_in_turn_are_cut_alike():
    texts = [*hard_texts(), "long text " * (AT_ONCE // 10 + 7), "", "end"]
    alone = [c for t in texts for c in cuts([t])]
    assert [(e, s) for _, e, s in cuts_in_turn(texts)] == alone
    for seed in range(5):
        mixed = random.Random(seed).sample(list(zip(texts, alone)), len(texts))
        assert [e for e, _ in cuts([t for t, _ in mixed])] == [c[0] for _, c in mixed]
