"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits), each read as a word of the perfect binary
Golay code (23, 12, 7) and decoded to its nearest codeword's 12-bit index.  Fingerprints that differ in at most two
bits differ in at most one bit over some two of the three segments, so of one of them a neighbour within one bit
decodes on that pair to just the other's codewords: every fingerprint *stores* its own index pair and *probes*
those of its one-bit neighbours, an equi-join finds candidates, and the bit distance is verified.

Buckets that store more than ``BUCKET`` fingerprints get wider keys: of three segments that hold two errors one is
free of errors, so the key is joined with each segment's own bits in turn and links meet where that segment is alike
(24 + 21 bits, so that buckets stay small for a hundred billion fingerprints).  A bucket that is still too large is a
dense cluster; its members meet at midpoints, also exact: two fingerprints are within two bits if and only if some
64-bit word is within one bit of both, and each word has at most 65 such neighbours.  No group is ever expanded into
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SHINGLE = 3
SEED = 42
BUCKET = 32
#: Fixed value: the generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the Golay code.
GENERATOR = 0xAE3
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())]


def _fingerprints(size: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.chunks(batches, "text", 1 << 20):
            hashes = [shingle_hashes(x, size, seed) for x in c.text_bytes(batch.column("text"))]
            n = np.array([len(h) for h in hashes])
            out = np.zeros(len(n), dtype=np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                flat = np.array([x for h in hashes for x in h], dtype="<u8")
                bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
                out[full] = np.packbits(ones * 2 > n[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): a bit of fp is 1 if over half of the text's shingle hashes have it; texts without words give 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(size, seed), "doc_id long, fp long")


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


class Golay:
    """Nearest-codeword decoding of 23-bit words by syndrome."""

    def __init__(self):
        patterns = [0, *(sum(1 << i for i in some) for k in (1, 2, 3) for some in combinations(range(23), k))]
        errors = np.array(patterns, dtype=np.int64)
        self.error = np.zeros(2048, dtype=np.int64)
        self.error[_remainder(errors)] = errors
        byte = np.arange(256, dtype=np.int64)
        self.parts = [_remainder(byte << s) if s < 16 else _remainder((byte & 0x7F) << s) for s in (0, 8, 16)]

    def decode(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the only codeword within three bits of each word."""
        a, b, d = self.parts
        syndrome = a[words & 255] ^ b[words >> 8 & 255] ^ d[words >> 16 & 127]
        return (words ^ self.error[syndrome]) >> 11


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for whole in batches:
        for at in range(0, whole.num_rows, 1 << 14):
            fp = whole.column("fp").slice(at, 1 << 14).to_numpy().view(np.uint64)
            own, near = [], []
            for shift, width in SEGMENTS:
                words = (fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
                own.append(golay.decode(words))
                near.append(golay.decode(words[:, None] ^ (1 << np.arange(width))))
            stores, probes = [], []
            for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                stores.append(tag << 24 | own[i] << 12 | own[j])
                left, right = near[i] << 12 | own[j][:, None], own[i][:, None] << 12 | near[j]
                both = np.sort(np.hstack([stores[-1][:, None] & 0xFFFFFF, left, right]), axis=1)
                new = np.ones(both.shape, dtype=bool)
                new[:, 1:] = both[:, 1:] != both[:, :-1]
                row, _ = np.nonzero(new)
                probes.append((row, tag << 24 | both[new]))
            rows = np.concatenate([np.tile(np.arange(len(fp)), 3), *(r for r, _ in probes)])
            keys = np.concatenate([*stores, *(k for _, k in probes)])
            store = np.arange(len(rows)) < 3 * len(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp.view(np.int64)[rows]), pa.array(store)], ["key", "fp", "store"])


def _widened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key joined with the number and the bits of each segment."""
    for batch in batches:
        key, own = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        for number, (shift, width) in enumerate(SEGMENTS):
            bits = (own >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((key << 24) | (number << 22) | bits), batch.column("fp"), batch.column("store")], ["key", "fp", "store"])


def _midpoints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.append(np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64))
    for whole in batches:
        for at in range(0, whole.num_rows, 1 << 12):
            fp = whole.column("fp").slice(at, 1 << 12).to_numpy().view(np.uint64)
            middle = (fp[:, None] ^ flips).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(middle.view(np.int64)), pa.array(np.repeat(fp, 65).view(np.int64))], ["middle", "fp"])


_KEYS = "key long, fp long, store boolean"


def _met(keys: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Links between stored and probing fingerprints of buckets that store at most ``bucket``; the rows of the others."""
    stores, probes = keys.filter("store").select("key", "fp"), keys.filter("not store").select("key", "fp")
    large = stores.groupBy("key").count().filter(F.col("count") > bucket).select("key")
    small = stores.join(large, "key", "left_anti")
    near = probes.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), "key")
    near = near.filter((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    return near, keys.join(large, "key", "left_semi")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with a > b: links whose connected components are those of all pairs of ``fps`` within two bits."""
    near, rest = _met(c.materialise(fps.select("fp").mapInArrow(_keys, _KEYS), "golay-keys"), bucket)
    wide = c.materialise(rest.select("key", "fp", "store").mapInArrow(_widened, _KEYS), "wide-keys")
    wide_near, dense = _met(wide, bucket)
    met = dense.select("fp").distinct().mapInArrow(_midpoints, "middle long, fp long").groupBy("middle").agg(F.collect_list("fp").alias("fps"))
    met = met.filter(F.size("fps") > 1).select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a > b")
    return near.union(wide_near).union(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(hi, lo): every node that is not its component's smallest, with the smallest.  Alternates large-star and
    small-star steps; each step moves every edge once and ends are cut to Parquet.  Hubs meet their edges in place."""
    edges = c.materialise(edges.select(F.col("a").alias("hi"), F.col("b").alias("lo")), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return edges
        before = tuple(state)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = c.join_sums(both, least, ["u"], "n", 2 * state[0]).filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = c.materialise(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "links", state[0])


def near_duplicates(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints link at two or fewer differing bits; component_id is the smallest
    doc_id that a document reaches over links, itself included.

    Null and empty texts have fingerprint zero and link like any other.  A null doc_id is never the smallest unless
    its component has no other.  Repeated rows give repeated results.  Other columns are not used.
    """
    own = c.materialise(fingerprints(docs, size, seed), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("root"), F.count("*").alias("n"))
    distinct = c.materialise(distinct, "distinct-fingerprints")
    rows, n_distinct = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    label = components(links(distinct)).select(F.col("hi").alias("fp"), F.col("lo").alias("label"))
    labelled = distinct.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("root").alias("component_id"), F.count("*").alias("members"))
    classes = c.materialise(c.join_sums(labelled, least, ["label"], "members", n_distinct).select("fp", "component_id", "n"), "classes")
    return c.join_sums(own, classes, ["fp"], "n", rows).select("doc_id", "fp", "component_id")
