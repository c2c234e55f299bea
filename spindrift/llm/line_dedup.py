"""Line dedup over levelled sorted runs of line hashes.

A *run* is a table (h1, h2, n) sorted by the 128-bit hash of a line's key; n counts the documents that hold the line.
The corpus comes in batches.  Each new batch's lines are merge-anti-joined with the runs of *settled* lines, those that
enough documents are known to hold, and what is left becomes a run of level 0; ``fanout`` runs of a level are compacted
into one run of the next (counts add up), and lines that reach the threshold there leave it for a run of settled lines.
A line's counts thus are either all in the runs of the levels, or it is settled, whatever the order of batches.  After
the last batch one merge of all levels settles the rest, and every text loses its settled lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Fixed value: the white space that a key loses at both ends.
SPACE = b" \t\n\x0b\x0c\r"
#: Frequent lines are broadcast up to this many (16 bytes each), joined beyond.
BROADCAST_LINES = 1_000_000
_RUN = "h1 long, h2 long, n long"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _digests(line_keys: Iterable[bytes]) -> bytes:
    return b"".join(map(xxhash.xxh3_128_digest, line_keys))


def _halves(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, dtype="<i8").reshape(-1, 2)


def _counted(with_batch: bool, n_batches: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.chunks(batches, "text", 4 << 20):
            found = [_digests(set(map(line_key, text.split(b"\n"))) - {b""}) for text in c.text_bytes(batch.column("text"))]
            pairs = _halves(b"".join(found))
            if not len(pairs):
                continue
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1)))
            n = np.diff(np.append(first, len(pairs)))
            columns = [pa.array(pairs[first, 0]), pa.array(pairs[first, 1]), pa.array(n)]
            names = ["h1", "h2", "n"]
            if with_batch:
                own = batch.column("batch")[0].as_py() % n_batches
                columns.append(pa.array(np.full(len(first), own, dtype=np.int32)))
                names.append("batch")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


class LineRuns:
    """The levelled store.  Runs lie as Parquet in the shared folder and are never changed in place: each is a frame
    over its file.  A compacted file holds the lines that it settles beside those of its run."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        """Add one batch's lines as a run of level 0, then compact."""
        counts = docs.select("text").mapInArrow(_counted(False, 1), _RUN).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        self._add_counts(c.materialise(counts.sortWithinPartitions("h1", "h2"), "line-batch"))

    def add_batches(self, docs: DataFrame, n_batches: int) -> None:
        """Add a table as ``n_batches`` batches.  One pass over the texts counts the lines of all; the batches then
        join the store one after another."""
        read = docs.select("text", F.spark_partition_id().alias("batch"))
        counts = read.mapInArrow(_counted(True, n_batches), f"{_RUN}, batch int").groupBy("batch", "h1", "h2").agg(F.sum("n").alias("n"))
        counts = c.materialise(counts.sortWithinPartitions("batch", "h1", "h2"), "line-batches")
        for r in counts.groupBy("batch").count().orderBy("batch").collect():  # at most n_batches
            self._add_counts(counts.filter(F.col("batch") == r.batch).select("h1", "h2", "n"), r["count"])

    def _add_counts(self, counts: DataFrame, rows: int | None = None) -> None:
        """``counts`` is a sorted run as it is while nothing is settled."""
        if self.settled:
            fresh = counts.join(_all(self.settled).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            counts = c.materialise(fresh.sortWithinPartitions("h1", "h2"), "line-run", counts.count() if rows is None else rows)
        self.levels[0].append(counts)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) >= self.fanout:
                merged, self.levels[level] = self.levels[level][: self.fanout], self.levels[level][self.fanout :]
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._merged(merged).filter(F.col("n") < self.min_docs))
            level += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One sorted file of the runs' sums, whose lines that reach ``min_docs`` are settled from now on."""
        rows = _all(runs)
        sums = c.materialise(_sums(rows).sortWithinPartitions("h1", "h2"), "line-runs", rows.count())
        self.settled.append(sums.filter(F.col("n") >= self.min_docs))
        return sums

    def frequent(self) -> DataFrame:
        """(h1, h2) of the lines that ``min_docs`` documents hold: merges all levels and settles what is left there."""
        rest = [run for level in self.levels for run in level]
        if rest:
            self._merged(rest)
            self.levels = [[]]
        found = _all(self.settled) if self.settled else self.spark.createDataFrame([], _RUN)
        return found.select("h1", "h2").distinct()

    def strip(self, docs: DataFrame, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
        """``docs`` without the lines that at least ``min_docs`` documents of the store hold.

        Returns the columns of ``docs`` with ``text`` changed, then n_lines and n_dropped (which replace columns of
        those names).  Null text stays null and counts as one empty line.  Small sets of frequent lines are
        broadcast after a count; larger ones meet the lines in a shuffled join.
        """
        frequent = c.materialise(self.frequent(), "frequent-lines", 0)
        docs = docs.drop("n_lines", "n_dropped")
        out = f"{_ddl(docs)}, n_lines long, n_dropped long"
        if frequent.count() <= broadcast_lines:
            table = frequent.toArrow()
            pairs = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in zip(*(table.column(n).to_pylist() for n in ("h1", "h2")))}
            known = self.spark.sparkContext.broadcast(frozenset(pairs))
            return docs.mapInArrow(_strip_known(known), out)
        dk, th, dropped = (c.free_name(docs, n) for n in ("dk", "th", "dropped_lines"))
        keyed = docs.withColumns({dk: c.doc_key(), th: F.xxhash64("text")})
        lines = keyed.select(F.col(dk).alias("dk"), F.col(th).alias("th"), "text").mapInArrow(_lines, "dk long, th long, line int, h1 long, h2 long")
        gone = lines.join(frequent, ["h1", "h2"], "left_semi").groupBy(F.col("dk").alias(dk), F.col("th").alias(th)).agg(F.collect_set("line").alias(dropped))
        return keyed.join(gone, [dk, th], "left").drop(dk, th).mapInArrow(_strip_listed(dropped), out)


def _all(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def _sums(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in c.chunks(batches, "text", 4 << 20):
        keys = [list(map(line_key, text.split(b"\n"))) for text in c.text_bytes(batch.column("text"))]
        n = np.array([len(k) for k in keys])
        pairs = _halves(b"".join(map(_digests, keys)))
        row = np.repeat(np.arange(len(keys)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        full = np.array([bool(k) for ks in keys for k in ks])
        dk, th = (batch.column(x).to_numpy(zero_copy_only=False)[row][full] for x in ("dk", "th"))
        yield pa.RecordBatch.from_arrays([pa.array(dk), pa.array(th), pa.array(at[full].astype(np.int32)), pa.array(pairs[full, 0]), pa.array(pairs[full, 1])], ["dk", "th", "line", "h1", "h2"])


def _rebuilt(batch: pa.RecordBatch, drops: Iterable[Callable[[list[bytes]], list[bytes]]], names: list[str]) -> pa.RecordBatch:
    texts, n_lines, n_dropped = [], [], []
    for text, drop in zip(batch.column("text").cast(pa.binary()).to_pylist(), drops):
        lines = (text or b"").split(b"\n")
        kept = drop(lines)
        texts.append(None if text is None else text if len(kept) == len(lines) else b"\n".join(kept))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
    columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])


def _strip_known(known):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, digest = known.value, xxhash.xxh3_128_digest

        def drop(lines):
            return [x for x in lines if not (key := line_key(x)) or digest(key) not in hashes]

        for batch in c.chunks(batches, "text", 4 << 20):
            yield _rebuilt(batch, iter(lambda: drop, None), batch.schema.names)

    return run


def _strip_listed(listed: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.chunks(batches, "text", 4 << 20):
            lists = [set(x or ()) for x in batch.column(listed).to_pylist()]
            drops = ((lambda lines, gone=gone: [x for i, x in enumerate(lines) if i not in gone]) for gone in lists)
            yield _rebuilt(batch, drops, [n for n in batch.schema.names if n != listed])

    return run


def drop_common_lines(docs: DataFrame, min_docs: int = 10, n_batches: int = 6, broadcast_lines: int = BROADCAST_LINES, fanout: int = 4) -> DataFrame:
    """Remove from every text the lines whose key at least ``min_docs`` rows of ``docs`` hold.

    Lines end at ``\\n``; a line's key is the line without the ASCII white space at both ends, A-Z lower-cased; an
    empty key is never removed.  Each row counts as a document: rows that share a doc_id, or have none, count one by
    one.  Null and empty texts are one empty line; texts of any length are split whole.  An empty table gives an empty
    result.
    """
    store = LineRuns(docs.sparkSession, min_docs, fanout=fanout)
    store.add_batches(docs, n_batches)
    return store.strip(docs, broadcast_lines)
