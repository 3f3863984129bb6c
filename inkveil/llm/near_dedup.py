"""MinHash near-deduplication: improved consistent weighted sampling over TF-IDF shingles.

1. The document frequency of every shingle is counted over all texts. Those of 2 or more are stored in the shared folder as sorted
   arrays, which workers memory-map; a shingle that is not there is in one text.
2. Each text gets K consistent weighted samples, banded by `ROWS`; texts with one multiset of shingles share a fingerprint and
   go on as one representative.
3. The rows of a band's buckets are range-partitioned and sorted, so that a large bucket spreads over many tasks. Inside it every
   text is compared with the others of its stretch by all K samples, and the links that join the most similar ones
   (a maximum spanning forest and the nearest texts) become candidates: their number is in proportion to the rows, whatever the bucket's size.
   Stretches and partitions overlap by some rows, so that the parts of a bucket stay connected.
4. Candidates are verified by the weighted Jaccard similarity of the whole texts; connected components of verified links are the classes.
5. Texts that share a bucket and are in different classes after that are compared with each other in blocks, and every such pair
   that its samples do not rule out is verified there too: step 3 saves work and decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm import arrays
from inkveil.llm.common import bounded_batches, discard, fresh, give_back, joined_by_key, partitions, stored
from inkveil.llm.lm import _BLOB, SHARD_BYTES, _dealt, _merged, _shard_of, shards_for
from inkveil.llm.shingles import U, mix, shingled, word_hashes

#: Where weights are given as an array, it has one for each of so many leading bits of a shingle's hash.
FEATURES_BITS = 18
#: Shingles that a task counts or weighs at once.
FLUSH, AT_ONCE = 400_000, 100_000
BANDS, ROWS = 12, 3
K = BANDS * ROWS
#: Samples of K that two texts of similarity 0.8 share with a probability above 0.99999.
LEAST_SHARED = 18
NEAREST = 3
STRETCH, OVERLAP = 256, 4
#: Rows of a block in step 5, where a row of more than 512 shingles counts as several.
BLOCK = 1024
#: Ids up to this number (16 bytes each) are broadcast to pick the texts to verify; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_draw = np.random.Generator(np.random.PCG64(20240229))
_A, _B = (_draw.integers(0, 2**64, K, dtype=np.uint64) | U(1) for _ in range(2))
#: 65 536 draws of Gamma(2, 1), from which a hash picks.
_GAMMA = -np.log(_draw.random(1 << 16) * _draw.random(1 << 16)).astype(np.float32)
_LOG_GAMMA = np.log(-np.log(_draw.random(1 << 16) * _draw.random(1 << 16))).astype(np.float32)
#: Elements that are sampled together, and the buffers for them.
TILE = 512
_tile = [np.empty((TILE, K), kind) for kind in (np.uint64, np.int64, np.float32, np.float32, np.float32, np.float32)]


@dataclass(frozen=True)
class Frequencies:
    """Where the shingles of two or more texts are, and the number of texts with shingles."""

    folder: str
    shards: int
    filled: frozenset[int]
    docs: int

    def of(self, h: np.ndarray) -> np.ndarray:
        """IDF of sorted distinct shingles: 1 + ln((N+1)/(df+1)) / ln(N+2), between 1 and 2."""
        df = np.ones(len(h), np.int64)
        shard = _shard_of(h, self.shards)
        borders = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        for at, end in zip(np.append(0, borders), np.append(borders, len(h)), strict=True) if len(h) else ():
            if (s := int(shard[at])) in self.filled:
                own, mine = arrays.load(self.folder, f"shingle-{s}"), h[at:end]
                place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                df[at:end] = np.where(own[place] == mine, arrays.load(self.folder, f"texts-{s}")[place], 1)
        return np.clip(1 + np.log((self.docs + 1) / (df + 1)) / np.log(self.docs + 2), 1, 2).astype(np.float32)


def _frequencies(frames: Iterator[pd.DataFrame], size: int, shards: int) -> Iterator[pd.DataFrame]:
    docs = 0
    kept, waiting, length = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        new = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
        waiting.clear()
        return arrays.summed(np.concatenate([kept[0], new[0]]), np.concatenate([kept[1], new[1]])) if len(kept[0]) else new

    for frame in frames:
        for words in word_hashes(frame["text"]):
            h = shingled(words, size)[0]
            docs += len(h) > 0
            waiting.append(h)
            length += len(h)
            if length > FLUSH:
                kept, length = gathered(), 0
                if len(kept[0]) > 3 * FLUSH:
                    yield _dealt(*kept, _shard_of(kept[0], shards))
                    kept = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    kept = gathered()
    yield _dealt(*kept, _shard_of(kept[0], shards))
    yield pd.DataFrame({"shard": [-1], "keys": [None], "counts": [None], "stats": [[docs]]})
    del kept
    give_back()


def _frequency_shard(group: pd.DataFrame, folder: str) -> pd.DataFrame:
    if group["shard"].iloc[0] < 0:
        shard, stats = -1, sum(int(x[0]) for x in group["stats"])
    else:
        shard, h, n = _merged(group)
        h, n = h[n > 1], n[n > 1]
        stats = len(h)
        if stats:
            arrays.save(folder, f"shingle-{shard}", h)
            arrays.save(folder, f"texts-{shard}", n.astype(np.uint32) if n.max() < 2**32 else n)
    give_back()
    return pd.DataFrame({"shard": [shard], "keys": [None], "counts": [None], "stats": [[stats]]})


def inverse_frequencies(texts: DataFrame, size: int = 5) -> Frequencies:
    """Counts in how many texts each shingle is, from all rows, and writes the counts of 2 or more to the shared folder."""
    spark = texts.sparkSession
    shards = shards_for(texts, SHARD_BYTES)
    folder = fresh(spark, "shingles")
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # all shingles are dealt out: their files go when they are counted
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        counted = texts.mapInPandas(partial(_frequencies, size=size, shards=shards), _BLOB)
        merged = counted.groupBy("shard").applyInPandas(partial(_frequency_shard, folder=folder), _BLOB)
        found = {r.shard: r.stats[0] for r in merged.select("shard", "stats").collect()}
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    docs = found.pop(-1, 0)
    return Frequencies(folder, shards, frozenset(s for s, n in found.items() if n), docs)


def _idf(h: np.ndarray, idf: Frequencies | np.ndarray) -> np.ndarray:
    return idf.of(h) if isinstance(idf, Frequencies) else idf[(h >> U(64 - FEATURES_BITS)).astype(np.int64)]


def weights(h: np.ndarray, n: np.ndarray, idf: Frequencies | np.ndarray) -> np.ndarray:
    """Of sorted distinct shingles that occur n times."""
    return ((1 + np.log(n)) * _idf(h, idf)).astype(np.float32)


def weighted(texts: Iterable[str | None], size: int, idf: Frequencies | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shingles of each text, how often each occurs, and weights; frequencies are looked up for many texts together."""
    waiting, length = [], 0

    def out() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        distinct, at = np.unique(np.concatenate([h for h, _ in waiting]), return_inverse=True)
        found = np.split(_idf(distinct, idf)[at], np.cumsum([len(h) for h, _ in waiting])[:-1])
        for (h, n), x in zip(waiting, found, strict=True):
            yield h, n, ((1 + np.log(n)) * x).astype(np.float32)

    for words in word_hashes(texts):
        waiting.append(shingled(words, size))
        length += len(waiting[-1][0])
        if length > AT_ONCE:
            yield from out()
            waiting, length = [], 0
    if waiting:
        yield from out()


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two pairs (sorted distinct shingles, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64)
    high = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low
    return float(low / high) if high > 0 else 0.0


def samples(h: np.ndarray, w: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """K samples of each weighted set: each names an element and its level; two sets share one with the probability of their similarity.

    h and w hold the elements of all sets (none empty) in a row, starts where each begins (default: one set). Sets go together through
    buffers that fit the cache, since most texts are short.
    """
    starts = np.zeros(1, np.int64) if starts is None else starts
    ends = np.append(starts[1:], len(h))
    best, name, k = np.full((len(starts), K), np.inf, np.float32), np.zeros((len(starts), K), np.uint64), np.arange(K)
    log_w = np.log(w).astype(np.float32)[:, None]
    for at in range(0, len(h), TILE):
        part, own = h[at : at + TILE], log_w[at : at + TILE]
        m = len(part)
        x, place, r, beta, t, cost = (buffer[:m] for buffer in _tile)
        np.add(np.multiply(part[:, None], _A, out=x), _B, out=x)
        draws = x.view(np.uint16).reshape(m, K, 4)  # 16 bits each: for r, c and beta
        place[...] = draws[:, :, 3]
        np.take(_GAMMA, place, out=r, mode="clip")
        place[...] = draws[:, :, 2]
        np.take(_LOG_GAMMA, place, out=cost, mode="clip")
        np.multiply(draws[:, :, 1], np.float32(2**-16), out=beta)
        np.divide(own, r, out=t)
        np.floor(np.add(t, beta, out=t), out=t)
        beta -= t
        beta -= np.float32(1)
        cost += np.multiply(beta, r, out=beta)
        sets = np.arange(np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + m))
        low, high = np.maximum(starts[sets] - at, 0), np.minimum(ends[sets] - at, m)
        row = np.stack([cost[a:b].argmin(0) + a for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        found = cost[row, k]
        better = found < best[sets]
        level = t[row, k].astype(np.int64).astype(np.uint64)
        best[sets] = np.where(better, found, best[sets])
        name[sets] = np.where(better, mix(part[row] + mix(level * U(64) + k.astype(np.uint64))), name[sets])
    return name


def _signatures(frames: Iterator[pd.DataFrame], size: int, idf) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ids, sets, rows = frame["id"].tolist(), [], []

        def out() -> None:
            full = [x for x in sets if len(x[1])]
            sets.clear()
            if not full:
                return
            starts = np.cumsum([0, *(len(h) for _, h, _, _ in full)])[:-1]
            h, n, w = (np.concatenate([x[c] for x in full]) for c in (1, 2, 3))
            name = samples(h, w, starts)
            bands = name.reshape(len(full), BANDS, ROWS)
            keys = mix(mix(mix(bands[:, :, 0] + np.arange(BANDS, dtype=np.uint64)) + bands[:, :, 1]) + bands[:, :, 2]).astype(np.int64)
            prints = [np.add.reduceat(mix(h + U(s)) * n.astype(np.uint64), starts).astype(np.int64).tolist() for s in (1, 2)]
            weight, sig = np.add.reduceat(w.astype(np.float64), starts).tolist(), (name & U(0xFF)).astype(np.uint8)
            rows.extend(zip([x[0] for x in full], *prints, weight, list(keys), [s.tobytes() for s in sig], strict=True))

        length = 0
        for doc, (h, n, w) in zip(ids, weighted(frame["text"], size, idf.value), strict=True):
            sets.append((doc, h, n, w))
            length += len(h)
            if length > 64 * TILE:
                out()
                length = 0
        out()
        yield pd.DataFrame(rows, columns=["id", "f1", "f2", "weight", "keys", "sig"])
    give_back()


def linked(ids: np.ndarray, sig: np.ndarray, weight: np.ndarray, threshold: float) -> set[tuple[int, int]]:
    """Candidate pairs (smaller id first) of one stretch: a maximum spanning forest by shared samples, and each text's nearest."""
    m = len(ids)
    shared = (sig[:, None, :] == sig[None, :, :]).sum(2, dtype=np.int16)
    heavy = np.maximum(weight[:, None], weight[None, :])
    shared[(np.minimum(weight[:, None], weight[None, :]) < threshold * heavy * (1 - 1e-9)) | (shared < LEAST_SHARED)] = 0
    np.fill_diagonal(shared, 0)
    shared[ids[:, None] == ids[None, :]] = 0
    if not shared.any():
        return set()
    if m <= NEAREST + 1:
        i, j = np.nonzero(np.triu(shared))
    else:
        near = np.argpartition(-shared, NEAREST, axis=1)[:, :NEAREST]
        i, j = np.repeat(np.arange(m), NEAREST), near.ravel()
        keep = shared[i, j] > 0
        i, j = list(i[keep]), list(j[keep])
        best, source, out = shared[0].copy(), np.zeros(m, np.int64), np.zeros(m, bool)
        out[0] = True
        for _ in range(m - 1):
            k = int(np.where(out, -1, best).argmax())
            out[k] = True
            if best[k] > 0:
                i.append(int(source[k]))
                j.append(k)
            closer = shared[k] > best
            best[closer], source[closer] = shared[k][closer], k
    return {(int(min(a, b)), int(max(a, b))) for a, b in zip(ids[i], ids[j], strict=True)}


_EDGE = "a long, b long, key long, nxt long, weight double, sig binary"


def _linked_buckets(frames: Iterator[pd.DataFrame], threshold: float, edges: bool) -> Iterator[pd.DataFrame]:
    """Candidate pairs (key null) of the sorted rows; with `edges`, also rows of the first and last bucket (b null)."""
    carry, first = None, True

    def border(run: pd.DataFrame) -> pd.DataFrame:
        few = run if len(run) <= 2 * OVERLAP else pd.concat([run[:OVERLAP], run[-OVERLAP:]])
        return pd.DataFrame({"a": few["id"], "b": None, "key": few["key"], "nxt": few["nxt"], "weight": few["weight"], "sig": few["sig"]})

    def link(run: pd.DataFrame) -> set[tuple[int, int]]:
        sig = np.frombuffer(b"".join(run["sig"]), np.uint8).reshape(len(run), K)
        return linked(run["id"].to_numpy(), sig, run["weight"].to_numpy(), threshold)

    def pairs(found: set[tuple[int, int]]) -> pd.DataFrame:
        a, b = zip(*found, strict=True)
        return pd.DataFrame({"a": a, "b": b, "key": None, "nxt": None, "weight": None, "sig": None})

    for frame in frames:
        if not len(frame):
            continue
        rows = frame if carry is None else pd.concat([carry, frame], ignore_index=True)
        key = rows["key"].to_numpy()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(starts[1:], len(rows))
        found: set[tuple[int, int]] = set()
        if first and len(starts) > 1:
            first = False
            if edges:
                yield border(rows[: ends[0]])
        for s, e in zip(starts[:-1], ends[:-1], strict=True):
            if e - s > 1:
                for at in range(s, max(s + 1, e - OVERLAP), STRETCH - OVERLAP):
                    found |= link(rows[at : min(e, at + STRETCH)])
        carry = rows[starts[-1] :]
        while len(carry) > 2 * STRETCH:  # an open bucket: its head goes, its first and latest rows stay for what follows
            found |= link(carry[:STRETCH])
            carry = pd.concat([carry[:OVERLAP], carry[STRETCH - OVERLAP :]])
        if found:
            yield pairs(found)
    if carry is not None:
        found = set()
        for at in range(0, max(1, len(carry) - OVERLAP), STRETCH - OVERLAP):
            found |= link(carry[at : at + STRETCH])
        if found:
            yield pairs(found)
        if edges:
            yield border(carry)
    give_back()


def candidates(signatures: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs a < b of representatives that a bucket links."""
    rows = signatures.select("id", "weight", "sig", "keys", F.posexplode("keys").alias("band", "key"))
    rows = rows.select("id", "weight", "sig", "key", F.get("keys", (F.col("band") + 1) % BANDS).alias("nxt"))
    dealt = rows.repartitionByRange(partitions(signatures.sparkSession), "key", "nxt", "id").sortWithinPartitions("key", "nxt", "weight", "id")
    found = stored(dealt.mapInPandas(partial(_linked_buckets, threshold=threshold, edges=True), _EDGE), "links")
    # the rows at the partitions' borders, a few for each partition, join the parts of buckets that were split
    borders = found.filter("b is null").select(F.col("a").alias("id"), "weight", "sig", "key", "nxt").distinct()
    across = borders.repartition("key").sortWithinPartitions("key", "nxt", "weight", "id").mapInPandas(partial(_linked_buckets, threshold=threshold, edges=False), _EDGE)
    return found.filter("b is not null").select("a", "b").unionByName(across.select("a", "b")).distinct()


def _sets(frames: Iterator[pd.DataFrame], size: int, idf) -> Iterator[pd.DataFrame]:
    """Distinct shingles of each text and their weights."""
    for frame in frames:
        sets = [(h.tobytes(), w.tobytes()) for h, _, w in weighted(frame["text"], size, idf.value)]
        yield pd.DataFrame({"id": frame["id"], "shingles": [h for h, _ in sets], "weights": [w for _, w in sets]})
    give_back()


class Cell:
    """Rows of a block that are compared with the rows of another block of the same bucket."""

    def __init__(self, rows: pd.DataFrame, threshold: float):
        self.threshold, self.rows = threshold, rows
        self.ids, self.group, self.weight = (rows[c].to_numpy() for c in ("id", "class", "weight"))
        self.sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), K)
        asks = rows["asks"].to_numpy(bool)
        self.asking = np.flatnonzero(asks)
        self.asked = np.arange(len(rows)) if rows["chunk"].iloc[0] < 0 else np.flatnonzero(~asks)

    def possible(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of rows in different classes that weights and samples do not rule out, in parts."""
        for at in range(0, len(self.asking), 64):
            part = self.asking[at : at + 64]
            low = np.minimum(self.weight[part][:, None], self.weight[self.asked][None, :])
            high = np.maximum(self.weight[part][:, None], self.weight[self.asked][None, :])
            i, j = np.nonzero((self.group[part][:, None] != self.group[self.asked][None, :]) & (low >= self.threshold * high * (1 - 1e-9)))
            i, j = part[i], self.asked[j]
            like = (self.sig[i] == self.sig[j]).sum(1) >= LEAST_SHARED
            yield i[like], j[like]

    def doubtful(self) -> pd.DataFrame:
        """The rows that have a possible partner."""
        found = np.zeros(len(self.ids), bool)
        for i, j in self.possible():
            found[i] = found[j] = True
        return pd.DataFrame({"id": np.unique(self.ids[found])})

    def links(self) -> pd.DataFrame:
        """Pairs (smaller id first) of similar texts, each in the first of the buckets that it shares."""
        keys = np.array(self.rows["keys"].tolist(), np.int64)
        key = self.rows["key"].iloc[0]
        lengths = np.array([len(x) // 8 for x in self.rows["shingles"]])
        ends = np.cumsum(lengths)
        h = np.frombuffer(b"".join(self.rows["shingles"]), np.uint64)
        at = np.unique(h, return_inverse=True)[1]
        w = np.frombuffer(b"".join(self.rows["weights"]), np.float32).astype(np.float64)
        places, values = np.split(at, ends[:-1]), np.split(w, ends[:-1])
        mine = np.zeros(at.max() + 1)
        a, b = [], []
        for i, j in self.possible():
            common = keys[i] == keys[j]
            first = keys[i, common.argmax(1)] == key
            i, j = i[first], j[first]
            for x in np.unique(i):
                others = j[i == x]
                mine[places[x]] = values[x]
                for cut in range(0, len(others), 256):
                    some = others[cut : cut + 256]
                    shared = np.minimum(mine[np.concatenate([places[y] for y in some])], np.concatenate([values[y] for y in some]))
                    low = np.add.reduceat(shared, np.append(0, np.cumsum(lengths[some])[:-1]))
                    some = some[low >= self.threshold * (self.weight[x] + self.weight[some] - low)]
                    a += [self.ids[x]] * len(some)
                    b += list(self.ids[some])
                mine[places[x]] = 0
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, dtype="int64")


def _by_cell(frames: Iterator[pd.DataFrame], threshold: float, links: bool) -> Iterator[pd.DataFrame]:
    """Of each cell the doubtful rows or, where the rows have their sets, the links."""
    carry: list[pd.DataFrame] = []

    def result(rows: pd.DataFrame) -> pd.DataFrame:
        cell = Cell(rows, threshold)
        return cell.links() if links else cell.doubtful()

    for frame in frames:
        if not len(frame):
            continue
        place = frame[["key", "block", "chunk"]].to_numpy()
        starts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
        if carry and (carry[-1][["key", "block", "chunk"]].to_numpy()[-1] != place[0]).any():
            starts = np.append(0, starts)
        if len(starts):
            head = pd.concat([*carry, frame[: starts[0]]]) if carry else frame[: starts[0]]
            found = [result(rows) for rows in (head, *(frame[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True))) if len(rows)]
            carry = [frame[starts[-1] :]]
            if found:
                yield pd.concat(found).drop_duplicates()
        else:
            carry.append(frame)
    if carry:
        yield result(pd.concat(carry))
    give_back()


def in_cells(rows: DataFrame) -> DataFrame:
    """Rows (key, id, class, cost, ...) dealt into cells: in every bucket with several classes, the rows outside its largest class
    meet all its rows. Both sides are dealt into blocks of about `BLOCK` in cost, and a cell holds one block of each, so that a large
    bucket spreads over many tasks.
    """
    counts = rows.groupBy("key", "class").agg(F.sum("cost").alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    mixed = mixed.select("key", "total", F.col("top.class").alias("top"), F.ceil((F.col("total") - F.col("top.n")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("total") / BLOCK).cast("int").alias("chunks"))
    mixed = stored(mixed, "mixed")
    one = F.lit(1)

    def cell(block, chunk, asks):
        return F.struct(block.cast("int").alias("block"), chunk.cast("int").alias("chunk"), asks.alias("asks"))

    asks = F.col("class") != F.col("top")
    asked = F.transform(F.sequence(one, "blocks"), lambda k: cell(k, F.pmod(F.xxhash64("id", F.lit(2)), "chunks") + 1, F.lit(False)))
    asking = F.transform(F.sequence(one, "chunks"), lambda k: cell(F.pmod(F.xxhash64("id", F.lit(3)), "blocks") + 1, k, F.lit(True)))
    cells = F.when(F.col("chunks") == 1, F.array(cell(one, F.lit(-1), asks))).when(asks, F.concat(asked, asking)).otherwise(asked)
    return joined_by_key(rows, mixed, ["key"], "total").select(*rows.columns, F.explode(cells).alias("cell")).select(*rows.columns, "cell.*")


def by_cell(placed: DataFrame) -> DataFrame:
    return placed.repartition(partitions(placed.sparkSession), "key", "block", "chunk").sortWithinPartitions("key", "block", "chunk")


def unsettled(known: DataFrame, signatures: DataFrame, grouped: DataFrame, size: int, threshold: float, idf) -> DataFrame:
    """All links a < b between texts that share a bucket and are in different classes.

    A first pass finds by their samples the texts that may have such a link. The second compares their whole sets of shingles; only
    links leave a cell, so that many texts of a bucket that are almost similar enough do not make many rows.
    """
    of = grouped.select(F.col("node").alias("id"), "class")
    placed = stored(signatures.join(of, "id", "left").select("id", F.coalesce("class", "id").alias("class"), "weight", "sig", "keys"), "placed")
    rows = placed.select("id", "class", "weight", "sig", F.lit(1).alias("cost"), F.explode("keys").alias("key"))
    doubtful = stored(by_cell(in_cells(rows)).mapInPandas(partial(_by_cell, threshold=threshold, links=False), "id long").distinct(), "doubtful")
    few = F.broadcast(doubtful) if doubtful.count() <= BROADCAST_IDS else doubtful
    sets = known.join(few, "id", "left_semi").dropDuplicates(["id"]).mapInPandas(partial(_sets, size=size, idf=idf), "id long, shingles binary, weights binary")
    held = stored(placed.join(sets, "id"), "sets")
    rows = held.select("id", "class", F.greatest(F.lit(1), F.expr("length(shingles) div 4096")).alias("cost"), F.explode("keys").alias("key"))
    # the sets join the rows only after most buckets have gone
    cells = in_cells(rows).join(held.drop("class"), "id")
    return by_cell(cells).mapInPandas(partial(_by_cell, threshold=threshold, links=True), "a long, b long").distinct()


def _verified(frames: Iterator[pd.DataFrame], size: int, threshold: float, idf) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = dict(zip(frame["a"], frame["text_a"], strict=True)) | dict(zip(frame["b"], frame["text_b"], strict=True))
        known = {doc: (h, w) for doc, (h, _, w) in zip(texts, weighted(texts.values(), size, idf.value), strict=True)}
        like = np.array([weighted_jaccard(known[a], known[b]) for a, b in zip(frame["a"], frame["b"], strict=True)], float)
        yield frame.loc[like >= threshold, ["a", "b"]]
    known = {}
    give_back()


def components(links: DataFrame) -> DataFrame:
    """node, class (smallest node of its connected component) of every node with a link.

    Alternates steps in which every node links its larger, then its smaller neighbours to the smallest one, until nothing changes.
    Minima are pre-aggregated, a node with very many links is joined where they are, and of the rounds' tables only the last one stays.
    """
    spark = links.sparkSession

    def step(links: DataFrame, larger: bool, made: list[str]) -> DataFrame:
        ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        made.append(fresh(spark, "least"))
        least = stored(ends.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least", made[-1])
        near = joined_by_key(ends, least, ["u"], "n")
        if larger:
            return near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        moved = near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    path, before = fresh(spark, "links"), None
    now = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct(), "links", path)
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("class"))
        made = [path, fresh(spark, "links"), path := fresh(spark, "links")]
        half = stored(step(now, True, made), "links", made[1])
        now, before = stored(step(half, False, made), "links", path), state
        for old in made:
            if old != path:
                discard(spark, old)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (smallest id of its class), kept (the class id's own row) of every row.

    Two texts are linked when the weighted Jaccard similarity of their TF-IDF shingles of `size` words is `threshold` or more;
    a class is a connected component. Words are compared with A-Z lower-cased. A text of fewer words is one shingle; null
    and empty texts have none, and each is a class of its own. Rows that share an id are one document and share its class: of several different
    texts of an id each counts where it has an exact copy, and for similar texts the one with the smallest fingerprint. A null id has
    a null class and is kept. Ids must be integers (others stop the job). An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = rows.filter("id is not null")
    idf = spark.sparkContext.broadcast(inverse_frequencies(known.select("text"), size))
    signatures = stored(known.mapInPandas(partial(_signatures, size=size, idf=idf), "id long, f1 long, f2 long, weight double, keys array<long>, sig binary"), "signatures")

    # copies: one representative for each multiset of shingles. Only representatives are compared; copies get their class in the end
    prints = signatures.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    groups = stored(prints.filter("n > 1"), "groups")
    copies = stored(joined_by_key(signatures.select("id", "f1", "f2"), groups, ["f1", "f2"], "n").select("id", "rep").filter("id != rep").distinct(), "copies")
    # a document with several texts may be a copy and a representative at once: it stays, and links its representatives
    chained = copies.join(groups.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    alone = stored(signatures.join(copies.select("id").exceptAll(chained.select("id")), "id", "left_anti").groupBy("id").agg(F.min_by(F.struct("weight", "keys", "sig"), F.struct("f1", "f2")).alias("s")).select("id", "s.*"), "representatives")

    pairs = stored(candidates(alone, threshold), "pairs")

    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    picked = known.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "id", "left_semi")
    texts = stored(picked, "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links = both.mapInPandas(partial(_verified, size=size, threshold=threshold, idf=idf), "a long, b long")
    several = copies.groupBy("id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps")).filter("size(reps) > 1").select("a", F.explode("reps").alias("b")).filter("a != b")
    grouped = components(links.unionByName(several).unionByName(chained.select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    rest = stored(unsettled(known, alone, grouped, size, threshold, idf), "rest")

    # links of the rest join whole classes
    class_of = lambda end: grouped.select(F.col("node").alias(end), F.col("class").alias(f"class_{end}"))
    joins = rest.join(class_of("a"), "a", "left").join(class_of("b"), "b", "left")
    joined = components(joins.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")))
    settled = grouped.join(joined.select(F.col("node").alias("class"), F.col("class").alias("last")), "class", "left").select("node", F.coalesce("last", "class").alias("class"))
    settled = stored(settled.unionByName(joined.join(grouped, "node", "left_anti")), "settled")

    # a representative's copies are many rows of one key
    reps = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).join(settled.withColumnRenamed("node", "rep"), "rep", "left")
    reps = stored(reps.select("rep", "n", F.coalesce("class", "rep").alias("class")), "reps")
    of_copies = joined_by_key(copies, reps, ["rep"], "n").groupBy("id").agg(F.min("class").alias("class")).withColumnRenamed("id", "node")
    of_all = stored(of_copies.unionByName(settled.join(of_copies, "node", "left_anti")), "classes")
    few = of_all.count() <= BROADCAST_IDS
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    found = ids.join(F.broadcast(of_all) if few else of_all, F.col("doc_id") == F.col("node"), "left")
    class_id = F.coalesce("class", "doc_id")
    return found.select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of one document of each class (that of the smallest id), with the columns of `docs`, which may have any name.

    Null ids, null and empty texts stay; an empty table gives no rows.
    """
    dropped = classes(docs, id_col, text_col, size, threshold).filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_id")).distinct()
    packed = docs.select(F.struct("*").alias("row"))
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return packed.join(dropped, F.col("row")[id_col] == F.col("dropped_id"), "left_anti").select("row.*")
