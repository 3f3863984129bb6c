"""Phrase collocation mining over count streams, in the layout of external stream estimation.

Texts become streams of word ids, and each order's n-grams are counted from the order before: an n-gram is the pair of its first and its last n-1
words, by their places in that order's sorted stream. A place is thus at once an identifier and a position in prefix order, and the
n-grams of the next order need only be counted where both parts are frequent. Every order is kept as a stream in prefix order; the
same rows sorted by their second place are in suffix order. Merge joins walk an order's streams and the one before in lockstep: the prefix walk brings left counts,
the suffix walk right counts, and both show extensions that are as frequent as what they extend. No table of n-grams is hashed or held whole:
tasks look places up by binary search in mapped sorted arrays, of SHARD entries each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm import arrays
from inkveil.llm.common import bounded_batches, discard, fresh, give_back, stored

#: Stands for a border in a stream of ids; ids are smaller, so that two of them make a positive 64-bit number.
NONE = np.uint32(0xFFFFFFFF)
MOST = 1 << 31
#: Entries of a sorted array.
SHARD = 4_000_000
#: Distinct n-grams that a task sums before it hands them on.
FLUSH = 1_500_000
#: Bytes of text that are split together (a longer text is cut at marks that end pieces).
BLOCK = 2 << 20
#: First steps of the choice of the best: so many parts of each language are cut down on their own.
PARTS = 256
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_BORDER = b"\xff"  # in no UTF-8 text


def _stretches(langs: list[str], texts: list[bytes | None]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Blocks of about BLOCK bytes of lower-case text; one text's stretches end at a mark that ends a piece."""
    block, size = ([], []), 0
    for lang, text in zip(langs, texts, strict=True):
        data, at = (text or b"").lower(), 0
        while at < len(data):
            mark = _BREAK.search(data, at + BLOCK) if len(data) - at > BLOCK else None
            end = mark.end() if mark else len(data)
            block[0].append(lang)
            block[1].append(data[at:end])
            size, at = size + end - at, end
            if size >= BLOCK:
                yield block
                block, size = ([], []), 0
    if block[0]:
        yield block


def _split(langs: list[str], texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a block's words: languages, the number of each word's language, of its piece, the distinct words, and the number of each word."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = _KIND[data]
    apart = kind > 0
    borders = np.flatnonzero(np.append(True, apart[:-1]) != apart)
    starts, ends = borders[::2], borders[1::2]
    pieces = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~apart].tobytes())]).dictionary_encode()
    names = sorted(set(langs))
    number = {x: k for k, x in enumerate(names)}
    of_text = np.fromiter((number[x] for x in langs), np.int64, len(langs))
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return names, of_text[np.searchsorted(text_ends, starts, "right")], pieces, words.dictionary, words.indices.to_numpy().astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for langs, texts in _stretches(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            yield _split(langs, texts)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (key: word, border, language) with their counts, summed in the task; the empty word stands for all words of a language."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "key"]).aggregate([("n", "sum")]).rename_columns(["lang", "key", "n"])

    for langs, lang, _, words, number in _blocks(batches):
        pairs, n = np.unique(lang * len(words) + number, return_counts=True)
        of = pairs // max(1, len(words))
        tails = [_BORDER + x.encode("utf-8", "surrogatepass") for x in langs]
        keys = [w + tails[k] for k, w in zip(of.tolist(), words.take(pa.array(pairs % max(1, len(words)))).to_pylist(), strict=True)]
        all_words = np.bincount(lang, minlength=len(langs))
        held.append(pa.table({"lang": [*(langs[k] for k in of.tolist()), *langs], "key": pa.array([*keys, *tails], pa.binary()), "n": np.append(n, all_words)}))
        if sum(t.num_rows for t in held) > FLUSH:
            held = [summed()]
            if held[0].num_rows > FLUSH // 2:
                yield from held.pop().to_batches(max_chunksize=50_000)
    if held:
        yield from summed().to_batches(max_chunksize=50_000)
    give_back()


def _save_words(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Saves a range's sorted words as bytes, offsets and first eight bytes, and numbers them."""
    part, keys = TaskContext.get().partitionId(), []
    for batch in batches:
        found = batch.column("key").to_pylist()
        yield _numbers(batch, part, len(keys))
        keys += found
    arrays.save(folder, f"bytes-{part}", np.frombuffer(b"".join(keys), np.uint8))
    arrays.save(folder, f"offsets-{part}", np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int64))
    arrays.save(folder, f"heads-{part}", np.array([int.from_bytes(k[:8].ljust(8, b"\0"), "big") for k in keys], np.uint64))


def _save_keys(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, keys, at = TaskContext.get().partitionId(), [], 0
    for batch in batches:
        yield _numbers(batch, part, at)
        keys.append(batch.column("key").to_numpy())
        at += batch.num_rows
    arrays.save(folder, f"keys-{part}", np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int64))


def _numbers(batch: pa.RecordBatch, part: int, at: int) -> pa.RecordBatch:
    return batch.append_column("part", pa.array(np.full(batch.num_rows, part, np.int32))).append_column("place", pa.array(np.arange(at, at + batch.num_rows)))


class Stream:
    """Where the sorted arrays of an order are: folder, and of each that is not empty the part, the first id and the first key."""

    def __init__(self, folder: str, parts: list[tuple]) -> None:
        self.folder, self.parts = folder, parts

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The ids of n-gram keys (NONE: not there), array by array in sorted order."""
        order = np.argsort(keys)
        ranked, found = keys[order], np.full(len(keys), NONE, np.uint32)
        cuts = np.searchsorted(ranked, [first for _, _, first in self.parts])
        for (part, start, _), a, b in zip(self.parts, cuts, [*cuts[1:], len(keys)], strict=True):
            if a < b:
                array = arrays.load(self.folder, f"keys-{part}")
                at = np.minimum(np.searchsorted(array, ranked[a:b]), len(array) - 1)
                found[order[a:b]] = np.where(array[at] == ranked[a:b], at + start, NONE)
        return found

    def word_places(self, keys: list[bytes]) -> np.ndarray:
        """The ids of word keys: by their first eight bytes, then whole."""
        heads = np.array([int.from_bytes(k[:8].ljust(8, b"\0"), "big") for k in keys], np.uint64)
        found = np.full(len(keys), NONE, np.uint32)
        for n, (part, start, first) in enumerate(self.parts):
            after = self.parts[n + 1][2] if n + 1 < len(self.parts) else None
            all_heads = arrays.load(self.folder, f"heads-{part}")
            lo, hi = np.searchsorted(all_heads, heads, "left"), np.searchsorted(all_heads, heads, "right")
            here = np.flatnonzero(lo < hi)
            data, offsets = memoryview(arrays.load(self.folder, f"bytes-{part}")), memoryview(arrays.load(self.folder, f"offsets-{part}"))
            for k, a, b in zip(here.tolist(), lo[here].tolist(), hi[here].tolist(), strict=True):
                key = keys[k]
                if key < first or after is not None and key >= after:
                    continue
                while a < b:
                    mid = (a + b) // 2
                    if data[offsets[mid] : offsets[mid + 1]].tobytes() < key:
                        a = mid + 1
                    else:
                        b = mid
                if a < len(all_heads) and data[offsets[a] : offsets[a + 1]].tobytes() == key:
                    found[k] = start + a
        return found


def _encode(words: Stream, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of word ids; NONE stands between pieces and for words that are not frequent."""
    for langs, lang, pieces, distinct, number in _blocks(batches):
        if not len(number):
            continue
        pairs, back = np.unique(lang * len(distinct) + number, return_inverse=True)
        tails = [_BORDER + x.encode("utf-8", "surrogatepass") for x in langs]
        texts = distinct.take(pa.array(pairs % len(distinct))).to_pylist()
        ids = words.word_places([w + tails[k] for k, w in zip((pairs // len(distinct)).tolist(), texts, strict=True)])[back]
        change = np.append(False, pieces[1:] != pieces[:-1])
        stream = np.full(len(ids) + int(change.sum()), NONE, np.uint32)
        stream[np.arange(len(ids)) + np.cumsum(change)] = ids
        bare = np.append(NONE, stream[:-1]) == NONE
        stream[bare & (np.append(stream[1:], NONE) == NONE)] = NONE  # a word alone makes no phrase
        stream = stream[(stream != NONE) | (np.append(NONE, stream[:-1]) != NONE)]
        yield pa.RecordBatch.from_pydict({"ids": [stream.tobytes()]})
    give_back()


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two ids without a border stand side by side, and their keys."""
    at = np.flatnonzero((ids[:-1] != NONE) & (ids[1:] != NONE))
    return at, ids[at].astype(np.int64) << 32 | ids[at + 1].astype(np.int64)


def _count_pairs(streams: list[Stream], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of the order after those of `streams` (of orders 2 and up), both parts of which are frequent."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        return arrays.summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def out() -> Iterator[pa.RecordBatch]:
        keys, n = held.pop()
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_pydict({"key": keys[k : k + 100_000], "n": n[k : k + 100_000]})

    for batch in batches:
        for blob in batch.column(0):
            ids = np.frombuffer(blob.as_buffer(), np.uint32)
            for stream in streams:
                at, keys = _pairs(ids)
                ids = np.full(max(0, len(ids) - 1), NONE, np.uint32)
                ids[at] = stream.places(keys)
            held.append(np.unique(_pairs(ids)[1], return_counts=True))
            if sum(len(k) for k, _ in held) > 2 * FLUSH:
                held = [summed()]
                if len(held[0][0]) > FLUSH:
                    yield from out()
    if held:
        held = [summed()]
        yield from out()
    give_back()


def _ranked(rows: DataFrame, name: str) -> tuple[DataFrame, Stream]:
    """Rows sorted by `key` in ranges, each saved as arrays; the rows with their ids (the places in the whole order)."""
    spark, folder = rows.sparkSession, fresh(rows.sparkSession, name)
    parts = max(1, -(-rows.count() // SHARD))
    ordered = rows.repartitionByRange(parts, "key").sortWithinPartitions("key")
    save = _save_words if name == "words" else _save_keys
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = stored(ordered.mapInArrow(partial(save, folder), f"{fields}, part int, place long"), f"{name}-rows")
    starts, total = [], 0
    for r in sorted(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).collect(), key=lambda r: r.part):
        starts.append((r.part, total, bytes(r["first"]) if name == "words" else r["first"]))
        total += r.n
    if total >= MOST:
        raise ValueError(f"{total} frequent {name}: there may be {MOST} at most")
    begun = spark.createDataFrame([(p, s) for p, s, _ in starts], "part int, start long")
    return rows.join(F.broadcast(begun), "part").withColumn("id", F.col("start") + F.col("place")).drop("part", "place", "start"), Stream(folder, starts)


def _joined(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """An order's rows from its stream (id, key, n) and the rows of the order before: in prefix order its left counts, in suffix order its right counts."""
    pairs = pairs.select("id", F.shiftright("key", 32).alias("pre"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("suf"), F.col("n").alias("a"))
    left = shorter.select(F.col("id").alias("pre"), F.col("a").alias("pre_a"), "lang", F.col("phrase").alias("head"), F.concat("ls", F.array("a")).alias("ls"))
    right = shorter.select(F.col("id").alias("suf"), F.col("a").alias("suf_a"), "last", F.concat("rs", F.array("a")).alias("rs"))
    rows = pairs.join(left.hint("merge"), "pre").join(right.hint("merge"), "suf")
    return rows.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "ls", "rs", "pre", "suf", "pre_a", "suf_a")


def _scored(order: int) -> tuple[Column, Column, Column]:
    """score, l and r of the cut with the lowest score (of equal ones the first): floor(1000 a n / (l r)) in decimals of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cut = lambda l, r, k: f"struct(({wide('a')} * 1000BD * {wide('n')}) div ({wide(l)} * {wide(r)}) as score, {k} as k, {l} as l, {r} as r)"  # noqa: E731, E741
    best = "array_min(array(" + ", ".join(cut(f"ls[{k - 1}]", f"rs[{order - k - 1}]", k) for k in range(1, order)) + "))"
    return tuple(F.expr(f"{best}.{x}").alias(x) for x in ("score", "l", "r"))


def mined(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, best: int = 2000) -> DataFrame:
    """The collocations of each language: lang, rank (from 1), phrase, a, l, r, n, score; the first `best` by score, a, phrase.

    A phrase of 2 to `longest` words counts all its occurrences inside pieces of texts, overlaps included, and takes part from `least` on. Its score is the lowest over all
    cuts, in exact numbers; phrases inside a longer one that is as frequent are left out. Null texts are empty, a null language is `und`; repeated rows
    count again; equal scores and counts are ordered by phrase. Without a frequent phrase, or without rows, the result is empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_count_words, "lang string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    word = F.expr("substring(key, 1, octet_length(key) - octet_length(lang) - 1)")
    counts = stored(counts.withColumn("word", word).filter((F.col("n") >= least) | (F.octet_length("word") == 0)), "word-counts")
    totals = counts.filter(F.octet_length("word") == 0).select("lang", "n")
    ranked, words = _ranked(counts.filter((F.octet_length("word") > 0) & (F.col("n") >= least)), "words")
    text = F.col("word").cast("string")
    shorter = stored(ranked.select("id", "lang", text.alias("phrase"), text.alias("last"), F.col("n").alias("a"), F.array().cast("array<long>").alias("ls"), F.array().cast("array<long>").alias("rs")), "order-1")
    encoded = stored(rows.mapInArrow(partial(_encode, words), "ids binary"), "encoded") if words.parts else None
    streams: list[Stream] = []
    scored = spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    orders = [shorter]
    for order in range(2, longest + 1) if words.parts else ():
        counts = encoded.mapInArrow(partial(_count_pairs, streams), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        ranked, stream = _ranked(stored(counts, f"counts-{order}"), f"order-{order}")
        if not stream.parts:
            break
        streams.append(stream)
        orders.append(stored(_joined(ranked, orders[-1]), f"order-{order}"))
    for order, now in enumerate(orders[1:], 2):
        if order < len(orders):
            longer = orders[order]
            held = longer.filter("a >= pre_a").select(F.col("pre").alias("id")).unionByName(longer.filter("a >= suf_a").select(F.col("suf").alias("id")))
            now = now.join(held, "id", "left_anti")
        now = now.join(totals, "lang").select("lang", "phrase", "a", "n", *_scored(order))
        scored = scored.unionByName(now)
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *keys: F.expr("row_number()").over(_window(*keys).orderBy(*by))
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    scored = scored.withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= best)
    scored = scored.withColumn("rank", rank("lang").cast("long")).filter(F.col("rank") <= best)
    found = stored(scored.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for stream in [words, *streams]:
        discard(spark, stream.folder)
    return found


def _window(*keys: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*keys)
