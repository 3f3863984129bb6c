"""Phrase mining against plain Python over the same rows."""

import itertools
import random
import re
from collections import Counter

import pytest

from inkveil.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, least, longest, best):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    rows = []
    for lang, c in f.items():
        c = {p: a for p, a in c.items() if a >= least}
        inside = {q for p, a in c.items() for i, j in itertools.combinations(range(len(p) + 1), 2) if j - i < len(p) and a >= c[q := p[i:j]]}
        found = []
        for p, a in c.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        rows += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)]
    return sorted(rows)


def corpus(seed):
    draw = random.Random(seed)
    words = ["a", "b", "B", "x\x01", "ab", "é", "É", "longword-one", "longword-two", "longword", "w\x00", "w", "日本"]
    docs = []
    for _ in range(120):
        text = "".join(draw.choice(words[: draw.randint(2, 13)]) + draw.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "\xa0"]) for _ in range(draw.randint(0, 60)))
        docs.append((draw.choice(["en", "en", "en", "", None, "en2", "e\xffn"]), text))
    return [*docs, ("en", None), ("de", ""), (None, "a a a a a a a a"), ("xx", "?!"), ("en", "a b " * 400 + "A B,a b")]


@pytest.mark.parametrize("seed, least, longest, best", [(1, 3, 5, 2000), (2, 5, 5, 7), (3, 2, 2, 50), (4, 4, 4, 2000)])
def test_brute_force(spark, seed, least, longest, best):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "lang string, text string, n long, key string").repartition(5)
    got = sorted(tuple(r) for r in phrases.mined(df, least=least, longest=longest, best=best).collect())
    assert got == expected(docs, least, longest, best)


def test_many_arrays_and_long_texts(spark, monkeypatch):
    """Streams of many arrays, flushed often; a text over many blocks."""
    draw = random.Random(9)
    text = "".join(draw.choice("abcdefghij") + draw.choice("ab") + draw.choice(["  ", " ", " ", ", "]) for _ in range(30_000))
    docs = [("en", text), ("de", text[::-1]), ("en", "xy " * 2000)]
    df = spark.createDataFrame(docs, "lang string, text string")
    want = expected(docs, 20, 3, 1000)
    monkeypatch.setattr(phrases, "SHARD", 40)
    got = sorted(tuple(r) for r in phrases.mined(df, least=20, longest=3, best=1000).collect())
    assert got == want and len(got) > 100


def test_stretches_end_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 10)
    blocks = list(phrases._stretches(["a", "b"], [b"One two three four, five six", None]))
    assert [(x, t.decode()) for langs, texts in blocks for x, t in zip(langs, texts, strict=True)] == [("a", "one two three four,"), ("a", " five six")]


@pytest.mark.parametrize("rows", [[], [("en", None), (None, "")], [("en", "one two three")]])
def test_nothing_frequent(spark, rows):
    got = phrases.mined(spark.createDataFrame(rows, "lang string, text string"))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
