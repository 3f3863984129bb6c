"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into chunks (blanks and what follows them, which no piece extends beyond), and the chunks not met
before are concatenated and indexed by a suffix array. Binary search gives every piece of the vocabulary its range of
occurrences; these are the edges of a lattice, which are sorted by position and relaxed: an edge reaches its end if its piece may
follow the piece that reached its start. Two pieces may follow each other when merging their characters by the model's
scores ends in just these two, which makes the one path to a chunk's end the model's own (BPE) segmentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import bounded_batches, give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Ids from here on stand for characters without a piece, while a batch is encoded.
FOREIGN = 1 << 24
#: Texts that are encoded and decoded together: their chunks are Python strings.
ROWS = 250


class Pieces:
    """The pieces of a model of type BPE with byte fallback, and what has been encoded by them so far (bounded)."""

    limit = 150_000
    #: Chunks that are indexed and relaxed together.
    together = 20_000
    #: Chunks of more bytes are relaxed one by one instead of all at once.
    long = 512

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        self.unknown = model.unk_id()
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.id_of = {model.id_to_piece(i): i for i in range(size) if not model.is_byte(i) and not special(i)}
        self.text_of = {i: p for p, i in self.id_of.items()}
        self.rank = {p: -model.get_score(i) for p, i in self.id_of.items()}
        shown = [b""] * size
        for p, i in self.id_of.items():
            shown[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            shown[i] = bytes([b])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.cumsum([0, *map(len, shown)])
        # where a piece has a blank after another character, chunks would cut it: the text is one chunk then
        cuts = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if cuts else r"(?s).+")
        self.ids = np.array(sorted(self.id_of.values()), np.int64)
        self.words, self.lengths = _words_of([self.text_of[i].encode() for i in self.ids.tolist()])
        self.forget()
        self.pairs, self.fit = np.zeros(1, np.int64), np.zeros(1, bool)

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # chunk: where its ids are
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merged(self, parts: list[str]) -> list[str]:
        """The merges of the model: of all neighbours that make a piece, the best one (then the leftmost) first."""
        ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == np.inf:
                break
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = self.rank.get(parts[k - 1] + parts[k], np.inf)
            if k < len(ranks):
                ranks[k] = self.rank.get(parts[k] + parts[k + 1], np.inf)
        return parts

    def name(self, piece: int) -> str:
        return chr(piece - FOREIGN) if piece >= FOREIGN else self.text_of[piece]

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """For each pair: whether merging the characters of both (before -1: of the piece alone) ends in just these."""
        keys = (before + 1) << 32 | piece
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        new = np.sort(keys[self.pairs[at] != keys])
        if len(new):
            new = new[np.append(True, new[1:] != new[:-1])]
            fits = []
            for k in new.tolist():
                a, b = (k >> 32) - 1, k & 0xFFFFFFFF
                both = [self.name(b)] if a < 0 else [self.name(a), self.name(b)]
                fits.append(self.merged(list("".join(both))) == both)
            if len(self.pairs) > 10 * self.limit:
                self.pairs, self.fit = np.zeros(1, np.int64), np.zeros(1, bool)
                return self.may_follow(before, piece)
            spot = np.searchsorted(self.pairs, new)
            self.pairs, self.fit = np.insert(self.pairs, spot, new), np.insert(self.fit, spot, fits)
            at = np.searchsorted(self.pairs, keys)
        return self.fit[at]

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end)."""
        chunks = [self.chunk.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > self.limit:
            self.forget()
        new = list(set(chain.from_iterable(chunks)).difference(self.known))
        for k in range(0, len(new), self.together):
            self.relax(new[k : k + self.together])
        count = np.fromiter(map(len, chunks), np.int64, len(chunks))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(chunks)), np.int64, int(count.sum()))
        size = self.at[which + 1] - self.at[which]
        before = np.append(0, np.cumsum(size))
        return self.flat[_ranges(self.at[which], size)], before[np.append(0, np.cumsum(count))]

    def relax(self, chunks: list[str]) -> None:
        foreign = sorted(ord(c) for c in set("".join(chunks)) if c not in self.id_of)
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        words, lengths = _words_of([chr(c).encode("utf-8", "surrogatepass") for c in foreign], self.words.shape[1])
        start, end, piece = occurrences(
            raw, np.concatenate([self.words, words]), np.concatenate([self.lengths, lengths]), np.append(self.ids, np.array(foreign, np.int64) + FOREIGN)
        )
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(size + 1) - size - 1
        # at every position: the last piece of the path to it (-1: a chunk's start, -2: not reached) and where that began
        last, back = np.full(int(first[-1] + size[-1]) + 2, -2, np.int64), np.zeros(int(first[-1] + size[-1]) + 2, np.int64)
        last[first] = -1
        of = np.repeat(np.arange(len(chunks)), size + 1)[start]
        short = size[of] <= self.long
        offset = (start - first[of])[short].astype(np.int16)
        order = np.flatnonzero(short)[np.argsort(offset, kind="stable")]
        bounds = np.searchsorted(np.sort(offset), np.arange(self.long + 1, dtype=np.int16))
        edges = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
        long = np.flatnonzero(~short)
        if len(long):  # one step for each position that has edges
            long = long[np.argsort(start[long], kind="stable")]
            edges += np.split(long, np.flatnonzero(np.diff(start[long])) + 1)
        for e in edges:
            e = e[last[start[e]] > -2]
            e = e[self.may_follow(last[start[e]], piece[e])] if len(e) else e
            last[end[e]], back[end[e]] = piece[e], start[e]
        if (last[first + size] == -2).any():
            raise ValueError("a chunk has no segmentation by this model's pieces and merges")
        # from the ends back to the starts, all chunks together
        owner, step, found = [], [], []
        live, at = np.arange(len(chunks)), first + size
        while len(live):
            owner.append(live)
            step.append(np.full(len(live), -len(step)))
            found.append(last[at])
            at = back[at]
            live, at = live[at > first[live]], at[at > first[live]]
        owner, step, found = np.concatenate(owner), np.concatenate(step), np.concatenate(found)
        order = np.lexsort((step, owner))
        owner, found = owner[order], found[order]
        # foreign characters become bytes
        far = np.flatnonzero(found >= FOREIGN)
        if len(far):
            spelled = [self.spelled(x) for x in found[far].tolist()]
            times = np.ones(len(found), np.int64)
            times[far] = list(map(len, spelled))
            places = np.repeat(np.append(0, np.cumsum(times))[far], times[far])
            inside = _ranges(np.zeros(len(far), np.int64), times[far])
            owner, found = np.repeat(owner, times), np.repeat(found, times)
            found[places + inside] = list(chain.from_iterable(spelled))
        base, total = len(self.known), len(self.flat)
        self.known.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.flat = np.append(self.flat, found.astype(np.int32))
        self.at = np.append(self.at, total + np.cumsum(np.bincount(owner, minlength=len(chunks))))

    def spelled(self, piece: int) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in chr(piece - FOREIGN).encode("utf-8", "surrogatepass")]

    def decoded(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts of ids in a row; text k has those from starts[k] to starts[k + 1]."""
        size = self.shown_at[ids + 1] - self.shown_at[ids]
        data = self.shown[_ranges(self.shown_at[ids], size)].tobytes()
        at = np.append(0, np.cumsum(size))[starts].tolist()
        texts = (data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False))
        return [t[1:] if t.startswith(" ") else t for t in texts]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `size` numbers, of every start."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _words_of(texts: list[bytes], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each text as a row of big-endian 64-bit words, filled up with zeros; the lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = width or -(-int(lengths.max(initial=1)) // 8)
    data = b"".join(t.ljust(8 * width, b"\0") for t in texts)
    return np.frombuffer(data, ">u8").astype(np.uint64).reshape(len(texts), width), lengths


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in the order of their first `depth` bytes, and the 8 bytes at every position as a number."""
    n = len(text)
    filled = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | filled[k : n + k]
    order = np.argsort(head)
    rank, width = np.empty(n, np.int64), 8
    rank[order] = np.cumsum(np.append(0, head[order][1:] != head[order][:-1]))
    while width < depth and rank[order[-1]] < n - 1:  # twice as many bytes each time
        later = np.zeros(n, np.int64)
        later[: n - width] = rank[width:] + 1
        key = (rank << 32) | later
        order = np.argsort(key)
        rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        width *= 2
    return order, head


def occurrences(texts: list[bytes], words: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and id of every occurrence of every piece in the texts, joined by zero bytes."""
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n, width = len(text), words.shape[1]
    order, head = suffix_array(text, 8 * width)
    head = np.append(head, np.zeros(8 * width, np.uint64))
    # for each word of 8 bytes: the pieces that are so long, their bytes there, and a mask of these bytes
    parts = []
    for k in range(width):
        at = np.flatnonzero(lengths > 8 * k)
        spare = 8 * (8 - np.minimum(lengths[at] - 8 * k, 8)).astype(np.uint64)
        parts.append((8 * k, at, words[at, k], ~np.uint64(0) << spare))

    def border(after: bool) -> np.ndarray:
        """The first suffix not below a piece, or (after) the first that is above all its extensions."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), n, np.int64)
        for _ in range(n.bit_length()):
            mid = (low + high) // 2
            suffix = order[np.minimum(mid, n - 1)]
            less, equal = np.zeros(len(words), bool), np.ones(len(words), bool)
            for skip, at, part, mask in parts:
                own = head[suffix[at] + skip] & mask
                less[at] |= equal[at] & (own < part)
                equal[at] &= own == part
            right = (less | equal if after else less) & (low < high)
            low, high = np.where(right, mid + 1, low), np.where(right | (low >= high), high, mid)
        return low

    low, high = border(False), border(True)
    count = high - low
    which = np.repeat(np.arange(len(words)), count)
    start = order[_ranges(low, count)]
    return start, start + lengths[which], ids[which]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encoded(batches: Iterator[pa.RecordBatch], text_col: str, path: str) -> Iterator[pa.RecordBatch]:
    give_back()  # what an earlier stage's tasks left in this worker
    model = pieces(path)
    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        texts = [t or "" for t in batch.column(text_col).to_pylist()]
        ids, starts = model.encoded(texts)
        back = [a == b for a, b in zip(model.decoded(ids, starts), texts, strict=True)]
        kept = [c for c in zip(batch.schema.names, batch.columns, strict=True) if c[0] not in ("piece_ids", "n_pieces", "round_trip")]
        names, columns = map(list, zip(*kept, strict=True))
        columns += [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)), pa.array(np.diff(starts)), pa.array(back, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "piece_ids", "n_pieces", "round_trip"])
    model.forget()
    give_back()


def encoded(docs: DataFrame, text_col: str = "text", path: str = MODEL) -> DataFrame:
    """The columns of `docs` and piece_ids, n_pieces, round_trip (decoding gives the text back) of every row.

    Columns of `docs` with these three names are replaced. The ids are those of the model's own library without a start or end piece. Null and empty texts have no pieces.
    A text with the character U+2581, which the model uses for blanks, decodes with blanks. `path` is a model file that
    every executor has. Rows are independent of each other; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession, 1000, 2)
    rows = docs.drop("piece_ids", "n_pieces", "round_trip")
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(partial(_encoded, text_col=text_col, path=path), f"{fields}, piece_ids array<int>, n_pieces long, round_trip boolean")


def _decoded(batches: Iterator[pa.RecordBatch], ids_col: str, path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        rows = batch.column(ids_col).to_pylist()
        starts = np.cumsum([0, *(len(r or ()) for r in rows)])
        texts = model.decoded(np.fromiter(chain.from_iterable(r or () for r in rows), np.int64, int(starts[-1])), starts)
        texts = [None if r is None else t for r, t in zip(rows, texts, strict=True)]
        names = [n for n in batch.schema.names if n != "decoded"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "decoded"])


def decoded(encodings: DataFrame, ids_col: str = "piece_ids", path: str = MODEL) -> DataFrame:
    """The columns of `encodings` and `decoded`: the text of the piece ids; null for null ids, bytes that are no UTF-8 as U+FFFD."""
    bounded_batches(encodings.sparkSession, 1000, 2)
    rows = encodings.drop("decoded")
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(partial(_decoded, ids_col=ids_col, path=path), f"{fields}, decoded string")


def decisions(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, piece_ids, n_pieces, round_trip of every row."""
    return encoded(docs.select(F.col("doc_id"), F.col("text")), "text", path).drop("text")
