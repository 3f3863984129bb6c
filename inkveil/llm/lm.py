"""LM scoring: an interpolated modified Kneser-Ney n-gram model of order 2 or 3, counted in Spark.

Tasks count words, then n-grams of their own texts and deal the sums out by shards; each shard is merged by one task and written to the
shared folder as sorted arrays. Words have dense ids, the places of their hashes in the sorted array, so that the key of two words is exact.
Pairs are sharded by ranges of their first word, triples by a hash of their first two words: a shard of triples has the keys of its contexts,
the place where each context's words begin, the words' ids and the counts. The number of shards follows the bytes of the texts, so that a shard
stays as small however large the corpus is. For order 3 the pairs' counts are continuation counts: in how many
triples a pair is the end. Scoring workers memory-map the arrays and look keys up by binary search; only sizes, discounts and shard
borders go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm import arrays
from inkveil.llm.common import bounded_batches, discard, fold, fresh, give_back, stored
from inkveil.llm.shingles import mix, word_hashes

#: Stands for the end of a text among the words' hashes.
END = np.uint64(0xA0761D6478BD642F)
FLUSH = 1_000_000
#: Bytes of text for each shard of the model.
SHARD_BYTES = 8 << 20
#: The sums of contexts with more words than this are stored; those of others are added up where they are needed.
LARGE = 32
_BLOB = "shard int, keys binary, counts binary, stats array<long>"
_TRIPLES = "shard int, keys binary, words binary, counts binary"


@dataclass(frozen=True)
class Model:
    """Where the arrays are and the few numbers that all of them share."""

    folder: str
    order: int
    shards: int
    offsets: tuple[int, ...]  # id of each shard's first word; the last is the number of words
    tokens: int
    bigrams: int
    top: tuple[float, float, float] | None  # discounts of the counts of triples
    high: tuple[float, float, float]  # discounts of the counts of pairs
    low: tuple[float, float, float]  # discounts of continuation counts
    low_mass: float

    @property
    def words(self) -> int:
        return self.offsets[-1]


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _dealt(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pd.DataFrame:
    """A row for each shard that sorted keys fall in."""
    starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, int)
    ends = np.append(starts[1:], len(keys))[: len(starts)]
    rows = [(int(shard[s]), arrays.packed(keys[s:e]), arrays.packed_counts(counts[s:e]), None) for s, e in zip(starts, ends, strict=True)]
    return pd.DataFrame(rows, columns=["shard", "keys", "counts", "stats"])


def _word_counts(frames: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    kept, waiting, length, docs = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0, 0

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        new = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
        waiting.clear()
        return arrays.summed(np.concatenate([kept[0], new[0]]), np.concatenate([kept[1], new[1]]))

    for frame in frames:
        for h in word_hashes(frame["text"]):
            waiting.append(h)
            length += len(h)
            docs += 1
            if length > FLUSH:
                kept, length = gathered(), 0
                if len(kept[0]) > FLUSH:
                    yield _dealt(*kept, _shard_of(kept[0], shards))
                    kept = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    kept = gathered()
    if docs:
        kept = arrays.summed(np.append(kept[0], END), np.append(kept[1], docs))
    yield _dealt(*kept, _shard_of(kept[0], shards))
    give_back()


def _merged(group: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([arrays.unpacked(x) for x in group["keys"]])
    counts = np.concatenate([arrays.unpacked_counts(x) for x in group["counts"]])
    return int(group["shard"].iloc[0]), *arrays.summed(keys, counts)


def _few(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, and 3 or more."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum())]


def _word_shard(group: pd.DataFrame, folder: str) -> pd.DataFrame:
    shard, h, n = _merged(group)
    arrays.save(folder, f"hash-{shard}", h)
    arrays.save(folder, f"count-{shard}", n)
    return pd.DataFrame({"shard": [shard], "keys": [None], "counts": [None], "stats": [[len(h), int(n.sum())]]})


class Words:
    """Ids of words, looked up in the memory-mapped hashes."""

    def __init__(self, folder: str, shards: int, offsets: tuple[int, ...]):
        self.folder, self.shards, self.offsets = folder, shards, offsets
        self.end = int(self.find(np.array([END]))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id of each hash; -1: never seen. The hashes must be sorted."""
        found = np.full(len(h), -1, np.int64)
        shard = _shard_of(h, self.shards)
        for s in np.unique(shard):
            if self.offsets[s + 1] == self.offsets[s]:
                continue
            mine = slice(*np.searchsorted(shard, [s, s + 1]))
            own = arrays.load(self.folder, f"hash-{s}")
            at = np.minimum(np.searchsorted(own, h[mine]), len(own) - 1)
            found[mine] = np.where(own[at] == h[mine], at + self.offsets[s], -1)
        return found

    def ids(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the tokens of all texts, an end after each text; where each text starts."""
        hashes = list(word_hashes(texts))
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes)) + 1
        starts = np.cumsum(sizes) - sizes
        end = np.array([END])
        distinct, place = np.unique(np.concatenate([x for h in hashes for x in (h, end)]), return_inverse=True)
        return self.find(distinct)[place], starts


def _contexts(ids: np.ndarray, starts: np.ndarray, start_id: int) -> np.ndarray:
    """The id before each token, the start's before the first ones."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts] = start_id
    return before


def _pair_counts(frames: Iterator[pd.DataFrame], folder: str, shards: int, offsets: tuple[int, ...]) -> Iterator[pd.DataFrame]:
    words, base = Words(folder, shards, offsets), np.uint64(offsets[-1] + 1)
    kept, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        new = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
        waiting.clear()
        return arrays.summed(np.concatenate([kept[0], new[0]]), np.concatenate([kept[1], new[1]]))

    def out() -> pd.DataFrame:
        return _dealt(*kept, _context_shard(kept[0] // base, offsets))

    for frame in frames:
        if not len(frame):
            continue
        ids, starts = words.ids(frame["text"])
        waiting.append(_contexts(ids, starts, offsets[-1]).astype(np.uint64) * base + ids.astype(np.uint64))
        if sum(map(len, waiting)) > FLUSH:
            kept = gathered()
            if len(kept[0]) > 3 * FLUSH:
                yield out()
                kept = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    kept = gathered()
    yield out()


def _context_shard(word: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """The shard of a context word; the start of texts is in the last one."""
    return np.minimum(np.searchsorted(offsets, word.astype(np.int64), "right") - 1, len(offsets) - 2)


def _summed_triples(pair: np.ndarray, word: np.ndarray, n: np.ndarray | None, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples in order, with the sum of their counts (None: 1 each)."""
    if base**3 < 2**64:  # a triple is one number
        key = pair * np.uint64(base) + word.astype(np.uint64)
        key, n = np.unique(key, return_counts=True) if n is None else arrays.summed(key, n)
        return key // np.uint64(base), (key % np.uint64(base)).astype(np.uint32), n
    order = np.lexsort((word, pair))
    pair, word = pair[order], word[order]
    starts = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (word[1:] != word[:-1]))) if len(pair) else np.zeros(0, int)
    n = np.ones(len(pair), np.int64) if n is None else n[order]
    return pair[starts], word[starts], np.add.reduceat(n, starts) if len(starts) else n


def _triple_counts(frames: Iterator[pd.DataFrame], folder: str, shards: int, offsets: tuple[int, ...]) -> Iterator[pd.DataFrame]:
    words, base, start = Words(folder, shards, offsets), np.uint64(offsets[-1] + 1), offsets[-1]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pd.DataFrame:
        pair, word = (np.concatenate([x[k] for x in waiting]) for k in (0, 1))
        waiting.clear()
        pair, word, n = _summed_triples(pair, word, None, int(base))
        shard = _shard_of(mix(pair), shards)
        rows = []
        order = np.argsort(shard, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            columns = word[mine].view(np.uint8).reshape(-1, 4).T.tobytes()
            rows.append((int(shard[mine[0]]), arrays.packed(pair[mine]), columns, arrays.packed_counts(n[mine])))
        return pd.DataFrame(rows, columns=["shard", "keys", "words", "counts"])

    length = 0
    for frame in frames:
        if not len(frame):
            continue
        ids, starts = words.ids(frame["text"])
        before = _contexts(ids, starts, start)
        pair = _contexts(before, starts, start).astype(np.uint64) * base + before.astype(np.uint64)
        waiting.append((pair, ids.astype(np.uint32)))
        length += len(ids)
        if length > FLUSH:
            yield out()
            length = 0
    if waiting:
        yield out()
    give_back()


def _triple_shard(group: pd.DataFrame, folder: str, offsets: tuple[int, ...]) -> pd.DataFrame:
    """Saves a shard of triples; gives the pairs at their ends, as often as there are distinct triples, and the counts of counts."""
    shard, base = int(group["shard"].iloc[0]), np.uint64(offsets[-1] + 1)
    pair = np.concatenate([arrays.unpacked(x) for x in group["keys"]])
    word = np.concatenate([np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for x in group["words"]])
    pair, word, n = _summed_triples(pair, word, np.concatenate([arrays.unpacked_counts(x) for x in group["counts"]]), int(base))
    del group
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    arrays.save(folder, f"context-{shard}", pair[first])
    arrays.save(folder, f"begin-{shard}", arrays.smallest(np.append(first, len(pair))))
    arrays.save(folder, f"word-{shard}", word)
    arrays.save(folder, f"times-{shard}", arrays.smallest(n))
    size = np.diff(np.append(first, len(pair)))
    large = np.flatnonzero(size > LARGE)
    sums = np.stack([np.add.reduceat(x.astype(np.int64), first)[large] for x in (n, n == 1, n == 2, n >= 3)], 1)
    arrays.save(folder, f"large-{shard}", arrays.smallest(large))
    arrays.save(folder, f"sums-{shard}", arrays.smallest(sums))
    few = _few(n)
    del n, first, size, sums
    pair = (pair % base) * base + word
    del word
    ends, m = np.unique(pair, return_counts=True)
    rows = _dealt(ends, m, _context_shard(ends // base, offsets))
    give_back()
    return pd.concat([rows, pd.DataFrame({"shard": [-1 - shard], "keys": [None], "counts": [None], "stats": [few]})], ignore_index=True)


def _pair_shard(group: pd.DataFrame, folder: str, shards: int, offsets: tuple[int, ...]) -> pd.DataFrame:
    shard, keys, n = _merged(group)
    base = np.uint64(offsets[-1] + 1)
    context = (keys // base).astype(np.int64) - offsets[shard]
    size = offsets[shard + 1] - offsets[shard] + 1  # the last shard also has the start of texts
    arrays.save(folder, f"next-{shard}", (keys % base).astype(np.uint32))
    arrays.save(folder, f"pairs-{shard}", arrays.smallest(n))
    arrays.save(folder, f"first-{shard}", arrays.smallest(np.searchsorted(context, np.arange(size + 1))))
    arrays.save(folder, f"total-{shard}", np.bincount(context, n, size).astype(np.int64))
    arrays.save(folder, f"kinds-{shard}", np.stack([np.bincount(context[x], minlength=size) for x in (n == 1, n == 2, n >= 3)], 1).astype(np.int32))
    word, m = np.unique(keys % base, return_counts=True)
    rows = _dealt(word, m, _context_shard(word, offsets))
    give_back()
    return pd.concat([rows, pd.DataFrame({"shard": [-1 - shard], "keys": [None], "counts": [None], "stats": [[len(keys), *_few(n)]]})], ignore_index=True)


def _continuation_shard(group: pd.DataFrame, folder: str, offsets: tuple[int, ...]) -> pd.DataFrame:
    shard, word, m = _merged(group)
    dense = np.zeros(offsets[shard + 1] - offsets[shard], np.int64)
    dense[word.astype(np.int64) - offsets[shard]] = m
    arrays.save(folder, f"before-{shard}", dense)
    return pd.DataFrame({"shard": [shard], "keys": [None], "counts": [None], "stats": [_few(m)]})


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of counts 1 to 4; half of them where a number is 0."""
    if min(n[:4]) == 0:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    found = (k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return tuple(float(min(max(d, 0.0), k)) for k, d in zip((1, 2, 3), found, strict=True))


def shards_for(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """As many shards as the bytes of column `text` fill, 16 at least."""
    return max(16, -(-texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // shard_bytes))


def trained(texts: DataFrame, order: int = 3, shard_bytes: int = SHARD_BYTES) -> Model:
    """Counts all rows of column `text` (null: empty, an end alone) and writes the model of order 2 or 3 to the shared folder."""
    if order not in (2, 3):
        raise ValueError("order is neither 2 nor 3")
    spark = texts.sparkSession
    shards = shards_for(texts, shard_bytes)
    folder = fresh(spark, "lm")
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # what was dealt out goes when it has been merged
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        counted = texts.mapInPandas(partial(_word_counts, shards=shards), _BLOB)
        sizes = {r.shard: r.stats for r in counted.groupBy("shard").applyInPandas(partial(_word_shard, folder=folder), _BLOB).select("shard", "stats").collect()}
        offsets = tuple(int(x) for x in np.cumsum([0, *(sizes.get(s, [0])[0] for s in range(shards))]))
        tokens = sum(x[1] for x in sizes.values())
        if offsets[-1] >= 2**32 - 1:
            raise ValueError("more than 2^32 - 2 distinct words: two of them do not fit a 64-bit key")
        where = {"folder": folder, "offsets": offsets}
        top = None
        if order == 3:
            triples = texts.mapInPandas(partial(_triple_counts, shards=shards, **where), _TRIPLES)
            table = fresh(spark, "ends")
            ends = stored(triples.groupBy("shard").applyInPandas(partial(_triple_shard, **where), _BLOB), "ends", table)
            top = discounts(np.array([r.stats for r in ends.filter("shard < 0").select("stats").collect()] or [[0] * 5]).sum(0).tolist())
            pairs = ends.filter("shard >= 0")
        else:
            pairs = texts.mapInPandas(partial(_pair_counts, shards=shards, **where), _BLOB)
        merged = stored(pairs.groupBy("shard").applyInPandas(partial(_pair_shard, shards=shards, **where), _BLOB), "pairs")
        if order == 3:
            discard(spark, table)
        high = np.array([r.stats for r in merged.filter("shard < 0").select("stats").collect()] or [[0] * 6]).sum(0)
        low = merged.filter("shard >= 0").groupBy("shard").applyInPandas(partial(_continuation_shard, **where), _BLOB)
        low = np.array([r.stats for r in low.select("stats").collect()] or [[0] * 5]).sum(0)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    d = discounts(low.tolist())
    mass = d[0] * low[0] + d[1] * low[1] + d[2] * low[4]
    return Model(folder, order, shards, offsets, int(tokens), int(high[0]), top, discounts(high[1:].tolist()), d, float(mass))


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, Words(model.folder, model.shards, model.offsets)

    def gather(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids (the start of texts, which is the last, has some too) from the arrays of their shards."""
        m = self.model
        shard = _context_shard(ids, m.offsets)
        parts = []
        for s in np.unique(shard):
            mine = ids[slice(*np.searchsorted(shard, [s, s + 1]))] - m.offsets[s]
            try:
                parts.append(arrays.load(m.folder, f"{name}-{s}")[mine])
            except FileNotFoundError:  # no pair has a context in this shard
                parts.append(np.zeros((len(mine), 3) if name == "kinds" else len(mine), np.int64))
        return np.concatenate(parts) if parts else np.zeros((0, 3) if name == "kinds" else 0, np.int64)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted pairs."""
        m = self.model
        found = np.zeros(len(keys), np.int64)
        context, word = (keys // np.uint64(m.words + 1)).astype(np.int64), (keys % np.uint64(m.words + 1)).astype(np.int64)
        shard = _context_shard(context, m.offsets)
        for s in np.unique(shard):
            mine = slice(*np.searchsorted(shard, [s, s + 1]))
            try:
                first = arrays.load(m.folder, f"first-{s}")
            except FileNotFoundError:
                continue
            own = context[mine] - m.offsets[s]
            low, high = first[own].astype(np.int64), first[own + 1].astype(np.int64)
            at, hit = _found(arrays.load(m.folder, f"next-{s}"), low, high, word[mine])
            found[mine] = np.where(hit, arrays.load(m.folder, f"pairs-{s}")[at], 0)
        return found

    def triple_parts(self, pair: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair and next word (-1: unknown): the share of the word's discounted count in the context's total, and what is left for shorter contexts."""
        m = self.model
        share, back = np.zeros(len(pair)), np.ones(len(pair))
        contexts, of = np.unique(pair, return_inverse=True)
        shard = _shard_of(mix(contexts), m.shards)
        order = np.argsort(shard, kind="stable")
        low, high, total, rest = (np.zeros(len(contexts), np.int64) for _ in range(4))
        rest = rest.astype(float)
        groups = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []
        held = []
        for mine in groups:
            s = int(shard[mine[0]])
            try:
                own = arrays.load(m.folder, f"context-{s}")
            except FileNotFoundError:  # the shard has no triples
                held.append(None)
                continue
            at = np.minimum(np.searchsorted(own, contexts[mine]), len(own) - 1)
            mine = mine[seen := own[at] == contexts[mine]]
            at = at[seen]
            begin, times = arrays.load(m.folder, f"begin-{s}"), arrays.load(m.folder, f"times-{s}")
            low[mine], high[mine] = begin[at], begin[at + 1]
            held.append((arrays.load(m.folder, f"word-{s}"), times))
            large, sums = arrays.load(m.folder, f"large-{s}"), arrays.load(m.folder, f"sums-{s}")
            wide = high[mine] - low[mine] > LARGE
            if wide.any():
                found = sums[np.searchsorted(large, at[wide])].astype(np.int64)
                total[mine[wide]], rest[mine[wide]] = found[:, 0], found[:, 1:] @ np.array(m.top)
            few = mine[~wide]
            if len(few):
                size = high[few] - low[few]
                n = times[_ranges(low[few], size)].astype(np.int64)
                starts = np.cumsum(size) - size
                total[few], rest[few] = np.add.reduceat(n, starts), np.add.reduceat(_discount(n, m.top), starts)
        seen = total > 0
        back = np.where(seen, rest / np.maximum(total, 1), 1.0)[of]
        ask = np.flatnonzero(seen[of] & (word >= 0))
        ask = ask[np.argsort(shard[of[ask]], kind="stable")]
        places = dict(zip((int(shard[g[0]]) for g in groups), held, strict=True))
        for mine in np.split(ask, np.flatnonzero(np.diff(shard[of[ask]])) + 1) if len(ask) else ():
            words, times = places[int(shard[of[mine[0]]])]
            c = of[mine]
            at, hit = _found(words, low[c], high[c], word[mine])
            n = np.where(hit, times[at], 0).astype(np.int64)
            share[mine] = (n - _discount(n, m.top)).clip(0) / total[c]
        return share, back

    def score(self, texts: pd.Series) -> pd.DataFrame:
        m = self.model
        ids, starts = self.words.ids(texts)
        word, place = np.unique(ids, return_inverse=True)
        known = word >= 0
        count, before = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        if m.words:
            count[known], before[known] = self.gather("count", word[known]), self.gather("before", word[known])
        if m.bigrams:
            lower = (before - _discount(before, m.low)).clip(0) / m.bigrams + m.low_mass / m.bigrams / (m.words + 1)
        else:
            lower = np.full(len(word), 1 / (m.words + 1))
        p = lower[place]
        context = _contexts(ids, starts, m.words)
        at, spot = np.unique(context, return_inverse=True)
        total, back = np.zeros(len(at), np.int64), np.ones(len(at))
        if m.bigrams:
            total[at >= 0] = self.gather("total", at[at >= 0])
            kinds = np.zeros((len(at), 3))
            kinds[at >= 0] = self.gather("kinds", at[at >= 0])
            seen = total > 0
            back[seen] = (kinds[seen] @ np.array(m.high)) / total[seen]
            both = np.flatnonzero((context >= 0) & (ids >= 0))
            key, where = np.unique(context[both].astype(np.uint64) * np.uint64(m.words + 1) + ids[both].astype(np.uint64), return_inverse=True)
            n = self.pair_counts(key)
            share = np.zeros(len(ids))
            share[both] = ((n - _discount(n, m.high)).clip(0))[where]
            p = share / np.maximum(total, 1)[spot] + back[spot] * p
            if m.order == 3:
                first = _contexts(context, starts, m.words)
                both = np.flatnonzero((first >= 0) & (context >= 0))
                share, rest = self.triple_parts(first[both].astype(np.uint64) * np.uint64(m.words + 1) + context[both].astype(np.uint64), ids[both])
                p[both] = share + rest * p[both]
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.words + 1)))[place]
        add = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({"n_tokens": add(np.ones(len(ids), np.int64)), "n_known": add((count > 0)[place].astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))})


def _found(numbers: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number would stand in its own sorted stretch [low, high) of `numbers` (a place that exists), and whether it is there."""
    low, high, end = low.copy(), high.copy(), high
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        less = numbers[mid] < want[live]
        low[live], high[live] = np.where(less, mid + 1, low[live]), np.where(less, high[live], mid)
        live = live[low[live] < high[live]]
    place = np.minimum(low, np.maximum(end - 1, 0))
    return place, (low < end) & (numbers[place] == want)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `size` numbers, of every start."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _scored(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    scorer = None
    for frame in frames:
        if not len(frame):
            continue
        scorer = scorer or Scorer(model)
        found = scorer.score(frame["text"])
        yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "held_out": frame["held_out"].to_numpy()}).assign(**{c: found[c].to_numpy() for c in found})
    scorer = None
    give_back()


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_fold: int = 1, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    Learns from the rows whose fold (crc32 of the id as text, modulo 5; null id: empty text) is not `held_out_fold`. Words are
    compared with A-Z lower-cased; a text's tokens are its words, then one end. base_score: unigrams with half a count added;
    score: log10 probability under the model of `order` (2 or 3; a text's first words have starts before them), where an unseen word has the mass
    of one unknown word. Ids must be integers (others stop the job). Null and empty texts are an end alone. Repeated rows are learned from as often as they occur; without rows to learn from, every probability is 1 over the number of known words plus 1.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 1000, 2)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == held_out_fold).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = trained(rows.filter(~F.col("held_out")).select("text"), order)
    found = rows.mapInPandas(partial(_scored, model=model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
