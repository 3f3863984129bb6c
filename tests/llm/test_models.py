"""The operators that work on batches, against brute force, a library or held-out rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import langid, lm, near_dedup, spm
from inkveil.llm.shingles import shingled, word_hashes

SF = "/root/testdata/sf0.001"


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def test_word_hashes():
    """Equal words, and no others, have equal hashes, wherever they stand and whatever is hashed with them."""
    texts = [None, "", " \t\n", "A b\x0bc\x0cd\re", "b a", "ab ba aab", "é É 😀 \xa0x", "x" * 300_000 + " x", "a" * 1000, *(f"w{k} W{k}" for k in range(3000))]
    found = {}
    for text, h in zip(texts, word_hashes(texts), strict=True):
        words = (text or "").encode().lower().split()
        assert len(h) == len(words)
        for w, x in zip(words, h.tolist(), strict=True):
            assert found.setdefault(w, x) == x
    assert len(set(found.values())) == len(found) > 3000


def test_words_of_repeated_parts_differ():
    """Words under which every polynomial hash modulo a power of two meets: the Thue-Morse word and its opposite."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    for size in (16, 64, 512, 1024, 4096):
        pair = word[:size], word[:size].translate(str.maketrans("ab", "ba"))
        one, two = word_hashes(pair)
        assert one[0] != two[0] and next(iter(word_hashes([" x " + pair[0]])))[1] == one[0]


# MinHash near-dedup


def corpus():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(12):
        text = [rng.choice(vocab) for _ in range(rng.choice([60, 200, 800]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(text)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [" ".join(rng.choice(vocab) for _ in range(70)) + " " + shared for _ in range(60)]
    rows += ["", None, "one two", "ONE two", "short", "\n \t"]
    return [(k, t) for k, t in enumerate(rows)]


def brute_classes(rows, idf, threshold=0.8):
    sets = {}
    for i, t in rows:
        h, n = shingled(*word_hashes([t]))
        sets[i] = h, near_dedup.weights(h, n, idf)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if len(sets[a][0]) and len(sets[b][0]) and near_dedup.weighted_jaccard(sets[a], sets[b]) >= threshold:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_near_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "z", 1.0) for r in rows], "doc_id long, text string, class string, id double")
    idf = near_dedup.inverse_frequencies(docs.select("text"))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == brute_classes(rows, idf)
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))


def test_near_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == brute_classes(rows, near_dedup.inverse_frequencies(docs.select("text")))


def test_near_weights_are_those_of_exact_frequencies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    idf = near_dedup.inverse_frequencies(docs)
    sets = [shingled(*word_hashes([r.text])) for r in docs.collect()]
    df = Counter(x for h, _ in sets for x in h.tolist())
    texts = sum(len(h) > 0 for h, _ in sets)
    for h, n in sets:
        want = [(1 + math.log(k)) * (1 + math.log((texts + 1) / (df[x] + 1)) / math.log(texts + 2)) for x, k in zip(h.tolist(), n.tolist(), strict=True)]
        assert near_dedup.weights(h, n, idf) == pytest.approx(want, rel=1e-6)
    assert max(df.values()) > 2 and near_dedup.weights(np.array([12345], np.uint64), np.ones(1), idf)[0] == pytest.approx(1 + math.log((texts + 1) / 2) / math.log(texts + 2), rel=1e-6)


def test_near_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b\nc d e  f"), (3, "q" * 300_000)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.classes(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 1, False), (3, 3, True)], key=str)
    assert near_dedup.classes(spark.createDataFrame([], docs.schema)).count() == 0


def test_samples_agree_with_the_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    w = rng.uniform(1, 3, 3000)
    a, b = (h[:2400], w[:2400]), (h[600:], w[600:])
    shared = (near_dedup.samples(*a) == near_dedup.samples(*b)).mean()
    assert abs(shared - w[600:2400].sum() / w.sum()) < 0.3
    # sets that go through together, across tiles, get the samples that they get alone
    sizes = [1, 3, 700, 2, 1500, 40]
    starts = np.cumsum([0, *sizes])[:-1]
    n = sum(sizes)
    together = near_dedup.samples(h[:n], w[:n], starts)
    for k, (at, size) in enumerate(zip(starts, sizes, strict=True)):
        assert (near_dedup.samples(h[at : at + size], w[at : at + size])[0] == together[k]).all()


def test_unsettled_compares_all_classes_of_a_bucket(spark, monkeypatch):
    """With all texts in one bucket and blocks smaller than it, exactly the similar pairs across classes are found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "LEAST_SHARED", 0)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for i in range(40):
        words = list(base)
        for _ in range(i % 6):
            words[rng.randrange(150)] = f"x{rng.randrange(1000)}"
        texts[i] = " ".join(words)
    idf = np.ones(1 << near_dedup.FEATURES_BITS, np.float32)
    sets = {}
    for i, text in texts.items():
        h, n = shingled(*word_hashes([text]))
        sets[i] = h, near_dedup.weights(h, n, idf)
    rows = [(i, float(s[1].sum()), bytearray(near_dedup.K), [7, 100 + i % 3] + [1000 * i + k for k in range(10)]) for i, s in sets.items()]
    signatures = spark.createDataFrame(rows, "id long, weight double, sig binary, keys array<long>")
    group = {i: 0 for i in range(12)}
    grouped = spark.createDataFrame(list(group.items()), "node long, class long")
    known = spark.createDataFrame(list(texts.items()), "id long, text string")
    found = near_dedup.unsettled(known, signatures, grouped, 5, 0.8, spark.sparkContext.broadcast(idf))
    want = [(a, b) for a in range(40) for b in range(a + 1, 40) if group.get(a, a) != group.get(b, b) and near_dedup.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    assert sorted((r.a, r.b) for r in found.collect()) == want
    assert 50 < len(want) < 700


def test_links_outside_the_spanning_forest_are_kept(spark, monkeypatch):
    """Classes do not depend on which candidates the forest takes: with none of them, the result is the same."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    idf = near_dedup.inverse_frequencies(docs.select("text"))
    monkeypatch.setattr(near_dedup, "candidates", lambda signatures, threshold: spark.createDataFrame([], "a long, b long"))
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == brute_classes(corpus(), idf)


def test_stretch_spans_a_large_bucket():
    """A bucket over many stretches and batches stays connected."""
    n = 3000
    frame = near_dedup.pd.DataFrame({"id": range(n), "key": 7, "nxt": 1, "weight": 10.0, "sig": [b"\1" * near_dedup.K] * n})
    parts = [frame[k : k + 500].reset_index(drop=True) for k in range(0, n, 500)]
    out = near_dedup.pd.concat(near_dedup._linked_buckets(iter(parts), 0.8, True))
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = out[out.b.notna()]
    for a, b in zip(pairs.a, pairs.b, strict=True):
        parent[root(int(a))] = root(int(b))
    assert len({root(i) for i in range(n)}) == 1 and len(pairs) < 5 * n


# LM scoring


def brute_scores(rows, order):
    texts = {k: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [b" end"] for k, (_, t) in enumerate(rows)}
    train = [texts[k] for k, (i, _) in enumerate(rows) if fold(i) != 1]
    pad = [b" start"] * (order - 1)
    grams = lambda t: zip(*[[*pad, *t][k:] for k in range(order)], strict=False)
    uni = Counter(w for t in train for w in t)
    levels = [Counter(g for t in train for g in grams(t))]  # counts of the whole order, then continuation counts
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels.reverse()
    few = lambda c: [sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]
    off = [lm.discounts(few(c)) for c in levels]
    d = lambda n, x: 0 if n == 0 else x[min(n, 3) - 1]
    totals, rests = [], []
    for c, x in zip(levels, off, strict=True):
        totals.append(Counter())
        rests.append(defaultdict(float))
        for g, n in c.items():
            totals[-1][g[:-1]] += n
            rests[-1][g[:-1]] += d(n, x)
    n_all, v = sum(uni.values()), len(uni)
    for k, (i, _) in enumerate(rows):
        score = base = 0.0
        for g in grams(texts[k]):
            p = 1 / (v + 1)
            for j in range(order):
                own = g[order - 1 - j :]
                total = totals[j][own[:-1]]
                if total:
                    p = (levels[j][own] - d(levels[j][own], off[j])) / total + rests[j][own[:-1]] / total * p
            score += math.log10(p)
            base += math.log10((uni[g[-1]] + 0.5) / (n_all + 0.5 * (v + 1)))
        yield i, fold(i) == 1, len(texts[k]), sum(uni[w] > 0 for w in texts[k]), n_all, base, score


def check_scores(spark, rows, order=3, schema="doc_id long, text string"):
    got = sorted((tuple(r)[:7] for r in lm.scored(spark.createDataFrame(rows, schema), order=order).collect()), key=str)
    want = sorted(brute_scores(rows, order), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_lm_on_documents(spark, order):
    check_scores(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()], order)


@pytest.mark.parametrize("order", [2, 3])
def test_lm_edges(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "LARGE", 1)
    check_scores(spark, [(1, "a b a"), (2, None), (3, ""), (None, "A b\x0bc\xa0d"), (5, "x " * 50_000), (5, "x y"), (7, "never seen 😀"), (8, "a b"), (9, "b a")], order)
    held = [k for k in range(200) if fold(k) == 1][:3]
    check_scores(spark, [(k, "only held out") for k in held], order)
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string"), order=order).count() == 0


def test_lm_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(k, t) for k, t in zip([2, 3, 4, 5], ["a b c a b", "b c d", "a a b", "d c b a"], strict=True) if fold(k) != 1], "doc_id long, text string")
    scorer = lm.Scorer(lm.trained(docs.select("text"), 2))
    one = lambda text: 10 ** scorer.score(near_dedup.pd.Series([text])).score[0]
    # P(w, end | start) = P(w | start) P(end | w): the first tokens' probabilities, an end or an unknown word among them, sum to 1
    words = set(" ".join(r.text for r in docs.collect()).split()) | {"unknown"}
    assert one("") + sum(one(w) / end_after(scorer, w) for w in words) == pytest.approx(1.0, rel=1e-6)


def end_after(scorer, word):
    m = scorer.model
    ids, _ = scorer.words.ids(near_dedup.pd.Series([word]))
    low = lambda c: 0.0 if c == 0 else m.low[min(c, 3) - 1]
    before = int(scorer.gather("before", np.array([scorer.words.end]))[0])
    p = (before - low(before)) / m.bigrams + m.low_mass / m.bigrams / (m.words + 1)
    if ids[0] < 0:
        return p
    total = int(scorer.gather("total", ids[:1])[0])
    kinds = scorer.gather("kinds", ids[:1])[0]
    c = int(scorer.pair_counts(np.array([ids[0] * (m.words + 1) + scorer.words.end], np.uint64))[0])
    return (c - (0 if c == 0 else m.high[min(c, 3) - 1])) / total + float(kinds @ np.array(m.high)) / total * p


# SentencePiece

TRICKY = [
    None, "", " ", "  x  y ", "a\nb\r\n\tc", "héllo wörld ß", "日本語のテキスト", "😀👍🏽", "<0x0A> <s> </s>", "_under __", "a" * 5000, "x" + " " * 40 + "y", "ﬁ ２ ½",
    "def f(x):\n        return x  # ok", "\x00\x01", "end ", "Ünïcödé " * 200, "https://a.b/c?d=e&f=1234567890",
]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, n_pieces string")
    got = spm.encoded(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.piece_ids == library.encode(r.text or ""), r.text
        assert r.n_pieces == len(r.piece_ids) and r.round_trip
    for r in spm.decoded(spm.decisions(docs)).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.decoded == (r.text or "")


def test_pieces_of_the_blank_character(spark):
    docs = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    r = spm.decisions(docs).first()
    assert not r.round_trip and spm.decoded(spm.decisions(docs)).first().decoded == "a b"


# Language ID


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.predicted(docs).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if fold(r.doc_id) == 0]
    assert all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_sees_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(docs).collect() if r.held_out}
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(other).collect() if r.held_out}


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    langs, table = langid.learned(docs.select("lang", "text"))
    text = {lang: docs.filter((F.col("lang") == lang) & (F.length("text") > 2000)).first().text[:2000] for lang in ("de", "fr")}
    bucket, n = langid.grams(text["de"] + " " + text["fr"])
    chosen, share = langid.inferred(bucket, n, table)
    assert {langs[k] for k in chosen} == {"de", "fr"} and 0.3 < share[1] < 0.5


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !? 😀", None), (4, "the cat", None), (None, "the dog and the cat", "en"), (6, "le chat et la souris", "fr"), (7, "the " * 100_000, "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.predicted(docs).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und"
    assert {r.doc_id for r in langid.accepted(docs).collect()} == {None, 4, 7}  # nothing French to learn from: 6 is held out
    assert langid.predicted(spark.createDataFrame([], docs.schema)).count() == 0
    alone = langid.predicted(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in alone.collect()} == {"und"}


def test_private_use_text_has_no_letter(spark):
    rows = [(1, "\U000f0000\U000f0001", None), (2, "𐐀𐐁𐐂", None), (3, "the dog", "en"), (4, "le chat", "fr"), (6, "el perro", "es")]
    got = {r.doc_id: r.lang_pred for r in langid.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == "und" and got[2] != "und"


def plain_grams(text):
    """Trigrams of letters and blanks with a letter in the middle, over words with one blank at either side."""
    x = re.sub(r"[^a]+", " ", "".join("a" if c.isalpha() else "_" for c in f" {text.lower()} "))
    letters = iter(c for c in text.lower() if c.isalpha())
    x = [next(letters) if c == "a" else " " for c in x]
    return Counter("".join(x[k : k + 3]) for k in range(len(x) - 2) if x[k + 1] != " ")


def test_languages_against_plain_mixture(spark):
    """Trigram counts, EM and the choice of the set, in plain Python with a dictionary of trigrams."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:60]
    docs += [(1000 + k, docs[k][1][:1500] + " " + docs[k + 20][1][:1500], None) for k in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predicted(frame).collect()}
    counts = defaultdict(Counter)
    for i, text, lang in docs:
        if fold(i) != 0 and lang is not None:
            counts[lang].update(plain_grams(text))
    langs, size = sorted(counts), 1 << langid.BITS
    total = {k: sum(counts[k].values()) + langid.SMOOTHING * size for k in langs}
    same = 0
    for i, text, _ in docs:
        grams = plain_grams(text)
        like = {k: {g: (counts[k][g] + langid.SMOOTHING) / total[k] for g in grams} for k in langs}

        def em(chosen):
            share = {k: 1 / len(chosen) for k in chosen}
            for _ in range(langid.ROUNDS):
                new = dict.fromkeys(chosen, 0.0)
                for g, n in grams.items():
                    whole = sum(share[k] * like[k][g] for k in chosen)
                    for k in chosen:
                        new[k] += n * share[k] * like[k][g] / whole
                share = {k: x / sum(new.values()) for k, x in new.items()}
            return share, sum(n * math.log(sum(share[k] * like[k][g] for k in chosen)) for g, n in grams.items())

        alone = {k: em([k])[1] for k in langs}
        chosen = [max(langs, key=lambda k: alone[k])]
        share, best = {chosen[0]: 1.0}, alone[chosen[0]]
        whole = em(langs)[0]
        for k in sorted(langs, key=lambda k: -whole[k]):
            if k in chosen or whole[k] < 0.02:
                continue
            mixed, found = em([*chosen, k])
            if found <= best + langid.PENALTY * math.log(sum(grams.values()) + 1):
                break
            chosen, share, best = [*chosen, k], mixed, found
        top = max(chosen, key=lambda k: share[k])
        assert got[i].lang_pred == top and got[i].score == pytest.approx(share[top], abs=0.03)  # buckets may hold two trigrams
        same += set(chosen) == {x.split(":")[0] for x in got[i].langs.split(",")}
    assert same >= len(docs) - 2
