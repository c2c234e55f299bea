"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents in one task.  Its words are coded by the benchmark's vocabulary (0 for any
other word) and cut at zeros; runs shorter than the shortest test phrase cannot hold one and are left out.  Over the
rest: suffix array, Burrows-Wheeler transform, wavelet-matrix ranks, backward search of all phrases at once, and
positions located by walking to sampled suffix positions.  Hits are merged into spans.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Fixed value: a word is a run of ASCII letters and digits and of all characters beyond ASCII.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A block of benchmark texts that is broadcast at once; larger benchmarks take several.
BLOCK_CHARS = 16_000_000
SAMPLE = 16


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Phrases:
    """The distinct windows of some items, coded by their own vocabulary.

    The items' codes lie in one sequence; a phrase is a place in it and a length, some 15 bytes a word with its items.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded, after, owners = array("i"), array("q"), []
        for name, words in items:
            coded.extend([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
            after.append(len(coded))
            owners.append(name)
        self.sequence, ends = np.array(coded, dtype=np.int32), np.array(after, dtype=np.int64)
        size = np.diff(ends, prepend=0)
        windows = np.maximum(size - self.window + 1, 1)
        starts = np.repeat(ends - size - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        lengths = np.repeat(np.minimum(size, self.window), windows)
        self.names = sorted(set(owners))
        number = {name: i for i, name in enumerate(self.names)}
        item = np.repeat(np.array([number[name] for name in owners], dtype=np.int64), windows)
        padded = np.append(self.sequence, np.zeros(self.window, dtype=np.int32))
        columns = [np.where(lengths > k, padded[starts + k], 0) for k in range(self.window)]
        order = np.lexsort((item, *columns))
        new = np.zeros(len(order), dtype=bool)  # codes are positive, so shorter windows differ from longer ones
        new[:1] = True
        for x in columns:
            new[1:] |= x[order[1:]] != x[order[:-1]]
        first = order[new]
        self.starts, self.lengths = starts[first].astype(np.int32), lengths[first]
        group, owner = np.cumsum(new) - 1, item[order]
        once = np.append(True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1]))[: len(order)]
        self.items = owner[once]
        self.first_item = np.append(0, np.cumsum(np.bincount(group[once], minlength=len(first))))
        self.shortest = int(self.lengths.min()) if len(first) else 0

    def symbols(self, rows: np.ndarray, back: int) -> np.ndarray:
        """The code that lies ``back`` places before the end of each phrase."""
        return self.sequence[self.starts[rows] + self.lengths[rows] - back].astype(np.int64)

    @property
    def codes(self) -> np.ndarray:
        """A row for each phrase, filled up with zeros."""
        padded = np.append(self.sequence, np.zeros(self.window, dtype=np.int32))
        at = np.arange(self.window)
        return np.where(at < self.lengths[:, None], padded[self.starts[:, None] + at], 0)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level at a time."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = sequence >> bit & 1
            before = np.zeros(len(sequence) + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(sequence) - int(before[-1])
            self.levels.append((bit, before, zeros))
            sequence = np.concatenate([sequence[ones == 0], sequence[ones == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before ``end``."""
        start = np.zeros_like(end)
        for bit, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = before[start], before[end]
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start


class FmIndex:
    """Index of a sequence of runs of positive codes, each run closed by a 0."""

    def __init__(self, codes: np.ndarray, top: int):
        n = len(codes)
        starts = np.append(True, codes[:-1] == 0)
        self.order = self._suffixes(codes)
        before = np.where(starts, 0, np.roll(codes, 1))[self.order]
        self.last = before
        self.tree = WaveletMatrix(before, max(1, int(top).bit_length()))
        self.first = np.cumsum(np.bincount(codes + 1, minlength=top + 2))[: top + 2]
        sampled = starts | (np.arange(n) % SAMPLE == 0)
        self.sampled = sampled[self.order]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.sample_at = self.order[self.sampled]
        del self.order

    @staticmethod
    def _suffixes(codes: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; zeros order by position, so no comparison runs beyond a run's end."""
        n = len(codes)
        zeros = codes == 0
        n_zeros = int(zeros.sum())
        rank = codes + n_zeros
        rank[zeros] = np.arange(n_zeros)
        order, step = np.argsort(rank, kind="stable"), 1
        while True:
            value = rank[order]
            dense = np.empty(n, dtype=np.int64)
            dense[order] = np.cumsum(np.append(False, value[1:] != value[:-1]))
            if n == 0 or dense[order[-1]] == n - 1:
                return order
            follow = np.zeros(n, dtype=np.int64)
            follow[: n - step] = dense[step:] + 1
            rank = dense * (n + 1) + follow
            order = np.argsort(rank, kind="stable")
            step *= 2

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array that begin with each phrase, as [low, high)."""
        n = len(phrases.starts)
        low, high = np.zeros(n, dtype=np.int64), np.full(n, len(self.last), dtype=np.int64)
        live = np.arange(n)
        for back in range(1, phrases.window + 1):
            live = live[phrases.lengths[live] >= back]
            symbol = phrases.symbols(live, back)
            base = self.first[symbol]
            low[live] = base + self.tree.rank(symbol, low[live])
            high[live] = base + self.tree.rank(symbol, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps, at, todo = np.zeros(len(rows), dtype=np.int64), rows.copy(), np.arange(len(rows))
        while True:
            todo = todo[~self.sampled[at[todo]]]
            if not len(todo):
                break
            symbol = self.last[at[todo]]
            at[todo] = self.first[symbol] + self.tree.rank(symbol, at[todo])
            steps[todo] += 1
        return self.sample_at[self.sample_rank[at]] + steps


def occurrences(codes: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, position in ``codes``) of every occurrence in a shard; zeros in ``codes`` match nothing."""
    none = np.zeros(0, dtype=np.int64)
    edge = np.diff(np.concatenate([[0], (codes > 0).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= phrases.shortest
    start, size = start[long], (end - start)[long] + 1  # with the zero that ends the run
    if not len(start) or not len(phrases.starts):
        return none, none
    place = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    index = FmIndex(np.append(codes, 0)[place].astype(np.int64), len(phrases.vocabulary))
    low, high = index.search(phrases)
    number = high - low
    number[phrases.lengths == 0] = 0
    rows = np.arange(int(number.sum())) + np.repeat(low - (np.cumsum(number) - number), number)
    return np.repeat(np.arange(len(number)), number), place[index.locate(rows)]


def _marked(shared, cut: bool = False):
    """Adds to each document the word spans hit by one block's phrases and the items they come from; ``cut``: removes
    all spans found so far from the text instead, and drops the added columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        get = phrases.vocabulary.get
        names = np.array(phrases.names, dtype=object)
        for batch in c.chunks(batches, "text", 2 << 20):
            words = [words_of(t) for t in c.text_bytes(batch.column("text"))]
            n = np.array([len(w) for w in words])
            ends = np.cumsum(n + 1)  # a zero after each document
            codes = np.fromiter((x for w in words for x in (*map(get, w, repeat(0)), 0)), dtype=np.int32, count=int(ends[-1]))
            which, at = occurrences(codes, phrases)
            doc = np.searchsorted(ends, at, "right")
            order = np.lexsort((at, doc))
            which, at, doc = which[order], at[order], doc[order]
            bounds = np.searchsorted(doc, np.arange(len(n) + 1))
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for d in np.unique(doc):
                s = slice(bounds[d], bounds[d + 1])
                lo = at[s] - (ends[d] - n[d] - 1)
                lo, hi = c.merge_spans(lo, lo + phrases.lengths[which[s]])
                hits[d] = [*hits[d], *({"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist()))]
                own = np.concatenate([phrases.items[phrases.first_item[w] : phrases.first_item[w + 1]] for w in np.unique(which[s])])
                items[d] = sorted({*items[d], *names[np.unique(own)].tolist()})
            fields = batch.schema.names
            columns = {f: batch.column(f) for f in fields}
            columns |= {"n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, batch.schema.field("hits").type), "items": pa.array(items, pa.list_(pa.string()))}
            marked = pa.RecordBatch.from_arrays([columns[f] for f in fields], fields)
            yield _without_hits(marked) if cut else marked

    return run


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[Phrases]:
    """One at least.  Words are coded as they come, so that a block's texts are never held together."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator()
    items = ((r.item_id, words, len(r.text)) for r in rows if r.item_id is not None and (words := words_of((r.text or "").encode("utf-8"))))
    none = True
    for first in items:
        yield Phrases(_some(first, items, block_chars), window)
        none = False
    if none:
        yield Phrases((), window)


def _some(first: tuple[str, list[bytes], int], items: Iterator[tuple[str, list[bytes], int]], block_chars: int) -> Iterator[tuple[str, list[bytes]]]:
    size = 0
    for name, words, chars in chain([first], items):
        yield name, words
        size += chars
        if size >= block_chars:
            return


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS, remove: bool = False) -> DataFrame:
    """The columns of ``docs`` and n_words, hits (merged word spans [lo, hi)) and items (sorted ids of items with an
    occurring window), which replace columns of those names.

    A window is ``window`` consecutive words of an item, or all words of a shorter one.  Benchmark texts are read in
    blocks of ``block_chars`` characters, each broadcast on its own, so the size of a broadcast is bounded.  Null and
    empty texts have no words; items with a null id or no words are left out; an empty benchmark hits nothing.

    With ``remove``, the pass over the last block cuts the spans out and the result is as that of
    :func:`remove_contamination`.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "hits", "items")
    found = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.expr("cast(array() as array<struct<lo: bigint, hi: bigint>>)"), "items": F.expr("cast(array() as array<string>)")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    blocks = [spark.sparkContext.broadcast(phrases) for phrases in _blocks(benchmark, window, block_chars)]
    for block in blocks[:-1]:
        found = found.mapInArrow(_marked(block), schema)
    return found.mapInArrow(_marked(blocks[-1], remove), plain if remove else schema)


def merged_hits(hits: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return c.merge_spans(np.array([h["lo"] for h in hits], dtype=np.int64), np.array([h["hi"] for h in hits], dtype=np.int64))


def _without_hits(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    for row, hits in enumerate(batch.column("hits").to_pylist()):
        if hits:
            texts[row] = without_words(texts[row], *merged_hits(hits))
    names = [n for n in batch.schema.names if n not in ("n_words", "hits", "items")]
    columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in names]
    return pa.RecordBatch.from_arrays(columns, names)


def _removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in c.chunks(batches, "text", 8 << 20):
        yield _without_hits(batch)


def without_words(text: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """``text`` without the bytes from the first to the last word of each span [lo, hi)."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist()):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def remove_contamination(found: DataFrame) -> DataFrame:
    """Cuts the hit spans out of the texts and drops what :func:`find_contamination` added."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name not in ("n_words", "hits", "items"))
    return found.mapInArrow(_removed, schema)
