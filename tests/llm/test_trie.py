"""The conversation trie against plain Python over the same rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from inkveil.llm import trie


def digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).hexdigest()[:30]


def expected(rows, splice=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + v[h:] if splice else v
    members = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in children.get(p, []))
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), len(children.get(p, [])), leaves[p], saved[p], ends(p)) for p, m in members.items()
    )


def corpus(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(60), -3, -5, 1000, 1003]:
        if draw.random() < 0.1:
            continue
        for turn in range(draw.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, draw.choice([turn, turn, None]), draw.choice(["user", "assistant", None, ""]), draw.choice(["a", "b", "é", "", None])))
    rows += draw.sample(rows, 5)  # repeated rows
    return [*rows, (None, 1, "user", "x"), (None, None, None, None)]


@pytest.mark.parametrize("seed, top, few, shard", [(1, 50_000, 100, 200_000), (2, 40, 1, 7), (3, 5, 3, 20), (4, 10_000, 1, 3)])
def test_brute_force(spark, seed, top, few, shard):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, conv string").repartition(6)
    got = trie.nodes(trie.rebuilt(trie.ordered(df)), top=top, few=few, shard=shard)
    assert sorted(tuple(-99 if x is None else x for x in r) for r in got.collect()) == expected(rows)


def test_deep_copies_and_many_blocks(spark, monkeypatch):
    """Long conversations over several blocks and ranges, two of them copies up to the last turn, and many copies of a short one."""
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = [(c, t, "user", f"turn {t}" if t < 99 or c != 2 else "other") for c in (1, 2) for t in range(100)] + [(7, t, "user", str(t)) for t in range(50)]
    rows += [(c, t, "assistant", "same") for c in range(100, 160) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for few in (1, 100):
        got = trie.nodes(trie.ordered(df), few=few)
        assert sorted(tuple(-99 if x is None else x for x in r) for r in got.collect()) == expected(rows, splice=False)


def test_role_and_text_do_not_run_together(spark):
    df = spark.createDataFrame([(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "a", "bc")], "conv_id long, turn long, role string, text string")
    assert sorted(r.n_convs for r in trie.nodes(trie.ordered(df)).collect()) == [1, 2, 3]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.nodes(trie.rebuilt(trie.ordered(df))).count() == 0


def test_perfect_hash():
    draw = np.random.default_rng(5)
    a, b = np.unique(draw.integers(-(2**63), 2**63 - 1, (2, 5000)), axis=1)
    table = trie.PerfectHash(a, b)
    assert sorted(table.slots(a, b)) == list(range(len(a)))
    assert (table.slots(a, b + 1) == -1).all() and not len(trie.PerfectHash(a[:0], b[:0]).slots(a[:0], b[:0]))
