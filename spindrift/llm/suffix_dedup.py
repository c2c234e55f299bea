"""Repeated byte strings: depth-limited most-significant-digit radix sort of corpus suffixes.

A suffix is sorted only through its first ``threshold`` bytes.  Suffixes whose windows are equal share the
position of their smallest ``GRAM``-byte string (the *anchor*), so a run of neighbouring suffixes with one anchor
moves through the passes as one item.

* pass 1, digit = anchor hash, then hash of the run's whole content: equal items are repeated windows throughout;
  an anchor with a single content is settled.  Where an anchor has several contents, a third of a run whose windows'
  common bytes (the *core*) no other content of the anchor has is settled too.
* pass 2, digit = each window's own hash, only for the thirds that are left (the edges of repeats): equal groups are
  exactly the repeated windows.

Each pass keeps one representative of equal items per task before the shuffle, so a string that a third of all
documents share sends one row per task.  A shorter string that many documents share in different surroundings is a
*hot* anchor of as many contents.  Hot anchors are found on a sample of the documents and take their next digits before
the shuffle: their runs are cut into thirds by core, and thirds of hot cores into single windows by content, so that
only equal windows share a key.  The sample decides only where items go; the result does not depend on it.

The order of strings within a digit is that of their 64-bit hashes, not of their bytes: equality is all that repeats
need.  Two hashes of 64 bits stand for content; inside an anchor one of them decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

GRAM = 32
#: One document in so many is sampled for hot anchors; a key is hot from so many contents in the sample on, at most so
#: many keys are.
SAMPLE, HOT_LEAST, HOT_KEYS = 32, 32, 20_000
#: Bytes of items that one task of the radix passes holds at once; an item has some 45 and a text byte makes some 1.6.
TASK_BYTES = 128 << 20
_SLICE = 1 << 20
_LOW = np.uint64(0xFFFFFF)
_MULT = 0x9E3779B97F4A7C15
_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []

_ITEM = pa.schema([("anchor", pa.int64()), ("full", pa.int64()), ("dk", pa.int64()), ("pos", pa.int64()), ("cores", pa.int64()), ("geo", pa.int32()), ("kind", pa.int8())])
ITEM, SETTLED, OPEN = 0, 1, 2


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SLICE + 4096)
        out = []
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class _Hashes:
    """Hashes of any substring of one buffer, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, lo, hi) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def grams(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int, hot: np.ndarray | None = None, parts: bool = False):
    """Items of a buffer that holds documents at [starts, ends): anchor hash, content hash, first start, cores,
    geometry; ``parts``: only keys and contents, of the items and of their thirds."""
    gram = min(GRAM, threshold)
    if len(data) < threshold:
        return None
    hashes = _Hashes(data)
    grams = hashes.grams(gram)
    keyed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min(keyed, threshold - gram + 1) & _LOW).astype(np.int64)
    count = np.maximum(ends - starts - threshold + 1, 0)
    total = int(count.sum())
    if not total:
        return None
    index = np.arange(total) + np.repeat(starts - (np.cumsum(count) - count), count)
    anchor = at[index]
    new = np.ones(total, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (index[1:] != index[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], total) - 1
    lo, hi, mark = index[first], index[last], anchor[first]
    key = grams[mark]
    if parts:
        third = tuple(_parts(hashes, lo, hi, mark, key, threshold))
        both = [np.concatenate([x, y]) for x, y in zip((lo, hi, mark, key), third)]
        return both[3].view(np.int64), _mix(hashes.of(both[0], both[1] + threshold) + (both[2] - both[0]).astype(np.uint64)).view(np.int64)
    if hot is not None and len(hot):
        lo, hi, mark, key = _spread(hashes, lo, hi, mark, key, threshold, hot)
    geo = ((mark - lo) << 12) | (hi - lo)
    full = _mix(hashes.of(lo, hi + threshold) + geo.astype(np.uint64))
    cores = np.zeros(len(lo), dtype=np.int64)
    for k, (near, far) in enumerate(_thirds(threshold)):
        present = (mark - hi <= far) & (mark - lo >= near)
        p = mark[present]
        cores[present] |= (hashes.of(p - near, p - far + threshold) >> np.uint64(43)).astype(np.int64) << (21 * k)
    return key.view(np.int64), full.view(np.int64), lo, cores, geo.astype(np.int32)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the ascending ``known``."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _parts(hashes: _Hashes, lo, hi, mark, key, threshold: int):
    """Runs cut into thirds, each with the hash of its anchor, its place and its core as key."""
    out = []
    for k, (near, far) in enumerate(_thirds(threshold)):
        present = (mark - hi <= far) & (mark - lo >= near)
        p = mark[present]
        core = hashes.of(p - near, p - far + threshold)
        out.append((np.maximum(lo[present], p - far), np.minimum(hi[present], p - near), p, _mix(key[present] + core * np.uint64(2 * k + 1) + np.uint64(k + 1))))
    return (np.concatenate(x) for x in zip(*out))


def _spread(hashes: _Hashes, lo, hi, mark, key, threshold: int, hot: np.ndarray):
    """Runs of hot anchors as thirds, thirds of hot cores as single windows."""
    some = _among(key, hot)
    if not some.any():
        return lo, hi, mark, key
    third = tuple(_parts(hashes, lo[some], hi[some], mark[some], key[some], threshold))
    dense = _among(third[3], hot)
    l, h, p, t = (x[dense] for x in third)
    n = h - l + 1
    start = np.arange(int(n.sum())) + np.repeat(l - (np.cumsum(n) - n), n)
    window = (start, start, np.repeat(p, n), _mix(hashes.of(start, start + threshold) + np.repeat(t, n)))
    return (np.concatenate([x[~some], y[~dense], z]) for x, y, z in zip((lo, hi, mark, key), third, window))


def _sampled_keys(threshold: int):
    """Keys of anchors and of thirds of a sample's runs, with the content under each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.chunks(batches, "text", 8 << 20):
            for data, starts, ends, _, _ in _slices(batch, threshold):
                if (x := _runs(data, starts, ends, threshold, parts=True)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in x], ["key", "full"])

    return run


def hot_keys(sample: DataFrame, threshold: int) -> np.ndarray:
    """The keys with most contents in ``sample``, ascending: HOT_LEAST each, HOT_KEYS in all."""
    keys = sample.mapInArrow(_sampled_keys(threshold), "key long, full long").groupBy("key", "full").agg(F.lit(1).alias("one"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_LEAST)
    found = sizes.orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").toArrow().column("key").to_numpy()
    return np.sort(found.view(np.uint64))


def _thirds(threshold: int) -> list[tuple[int, int]]:
    """Distances of window starts before their anchor, in three ranges."""
    width = threshold - min(GRAM, threshold) + 1
    step = -(-width // 3)
    return [(k, min(k + step, width) - 1) for k in range(0, width, step)]


def _slices(batch: pa.RecordBatch, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, row numbers, offsets in the documents) of at most about _SLICE bytes each."""
    parts, rows, offs, size = [], [], [], 0

    def flush():
        lengths = np.array([len(x) for x in parts], dtype=np.int64)
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(parts), dtype=np.uint8), ends - lengths, ends, np.array(rows), np.array(offs)

    for row, text in enumerate(c.text_bytes(batch.column("text"))):
        step = _SLICE
        for at in range(0, max(len(text) - threshold + 1, 0), step):
            piece = text[at : at + step + threshold - 1] if len(text) > step else text
            parts.append(piece)
            rows.append(row)
            offs.append(at)
            size += len(piece)
            if size >= _SLICE:
                yield flush()
                parts, rows, offs, size = [], [], [], 0
    if parts:
        yield flush()


def _order_and_firsts(digits: list[np.ndarray], dk: np.ndarray, pos: np.ndarray):
    """Radix order by ``digits``, then place; for each item in that order whether its group begins there, and
    whether a strictly earlier copy exists."""
    order = np.lexsort((pos, dk, *digits[::-1]))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for d in digits:
        s = d[order]
        new[1:] |= s[1:] != s[:-1]
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    head = order[heads][group]
    later = (dk[order] != dk[head]) | (pos[order] != pos[head])
    return order, new, later


def _first_pass(threshold: int, hot: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in c.chunks(batches, "text", 8 << 20):
            dks, ths = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("dk", "th"))
            for data, starts, ends, rows, offs in _slices(batch, threshold):
                if (x := _runs(data, starts, ends, threshold, hot)) is not None:
                    anchor, full, lo, cores, geo = x
                    doc = np.searchsorted(starts, lo, "right") - 1
                    place = (ths[rows[doc]] << 32) | (lo - starts[doc] + offs[doc])
                    found.append((anchor, full, dks[rows[doc]], place, cores, geo))
        if not found:
            return
        anchor, full, dk, pos, cores, geo = (np.concatenate(x) for x in zip(*found))
        del found
        order, _, later = _order_and_firsts([anchor, full], dk, pos)
        keep, gone = order[~later], order[later]
        yield from _emit(anchor[keep], full[keep], dk[keep], pos[keep], cores[keep], geo[keep], ITEM)
        yield from _emit_settled(dk[gone], pos[gone], (geo[gone] & 0xFFF) + threshold)
        del anchor, full, dk, pos, cores, geo, order, later, keep, gone
        c.trim()

    return run


def _emit(anchor, full, dk, pos, cores, geo, kind: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(dk), 1 << 16):
        s = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (anchor, full, dk, pos, cores, geo)] + [pa.array(np.full(len(dk[s]), kind, dtype=np.int8))], schema=_ITEM)


def _emit_settled(dk: np.ndarray, pos: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Removed spans, those of one document merged where they meet; ``geo`` is the length."""
    if not len(dk):
        return
    order = np.lexsort((pos, dk))
    dk, lo, hi = dk[order], pos[order], (pos + length)[order]
    doc = np.cumsum(np.append(True, (dk[1:] != dk[:-1]) | (lo[1:] >> 32 != lo[:-1] >> 32))) - 1
    base = (lo >> 32) << 32
    reach = np.maximum.accumulate((hi - base) + doc * (1 << 33)) - doc * (1 << 33) + base
    new = np.ones(len(dk), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(dk)) - 1
    dk, lo, hi = dk[first], lo[first], reach[last]
    spread = _mix(dk.view(np.uint64) + lo.view(np.uint64)).view(np.int64)
    yield from _emit(spread, np.zeros_like(dk), dk, lo, np.zeros_like(dk), (hi - lo).astype(np.int32), SETTLED)


def _load(batches: Iterable[pa.RecordBatch]):
    table = pa.Table.from_batches(list(batches), schema=_ITEM)
    return [table.column(n).to_numpy() for n in _ITEM.names]


def _second_digit(threshold: int):
    """All items of some anchors: copies of a content are settled; contents of anchors with several go on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, full, dk, pos, cores, geo, kind = _load(batches)
        done = kind == SETTLED
        yield from _emit(anchor[done], full[done], dk[done], pos[done], cores[done], geo[done], SETTLED)
        anchor, full, dk, pos, cores, geo = (x[~done] for x in (anchor, full, dk, pos, cores, geo))
        if not len(dk):
            return
        order, new, later = _order_and_firsts([anchor, full], dk, pos)
        gone = order[later]
        yield from _emit_settled(dk[gone], pos[gone], (geo[gone] & 0xFFF) + threshold)
        heads = order[new]
        heads = heads[_shared(anchor[heads])]
        for k, (near, far) in enumerate(_thirds(threshold)):
            own = cores[heads] >> (21 * k) & 0x1FFFFF
            most = (geo[heads] >> 12).astype(np.int64)
            least = most - (geo[heads] & 0xFFF)
            here = heads[(least <= far) & (most >= near)]
            still = here[_shared(_mix(anchor[here].view(np.uint64) + own[(least <= far) & (most >= near)].astype(np.uint64)))]
            most = (geo[still] >> 12).astype(np.int64)
            least = np.maximum(most - (geo[still] & 0xFFF), near)
            first = np.minimum(most, far)
            yield from _emit(anchor[still], full[still], dk[still], pos[still] + most - first, cores[still], (first - least).astype(np.int32), OPEN)
        del anchor, full, dk, pos, cores, geo, order, new, later, gone, heads
        c.trim()

    return run


def _shared(x: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    _, group, size = np.unique(x, return_inverse=True, return_counts=True)
    return size[group] > 1


def _windows(threshold: int):
    """Windows of the open items of each document, one representative per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in c.chunks(batches, "text", 8 << 20):
            for dk, th, text, opens in zip(*(batch.column(n).to_pylist() for n in ("dk", "th")), c.text_bytes(batch.column("text")), batch.column("opens").to_pylist()):
                if not opens:
                    continue
                lo = np.array([x["lo"] for x in opens], dtype=np.int64)
                span = np.array([x["geo"] for x in opens], dtype=np.int64) & 0xFFF
                mark = np.array([x["anchor"] for x in opens], dtype=np.int64)
                for at in range(0, len(text), _SLICE):  # long texts by slices, windows by where they start
                    own = (lo < at + _SLICE) & (lo + span >= at)
                    if own.any():
                        hashes = _Hashes(np.frombuffer(text[at : at + _SLICE + threshold], dtype=np.uint8))
                        l, h = np.maximum(lo[own], at), np.minimum(lo[own] + span[own], at + _SLICE - 1)
                        n = h - l + 1
                        s = np.arange(int(n.sum())) + np.repeat(l - (np.cumsum(n) - n), n)
                        found.append((hashes.of(s - at, s - at + threshold).view(np.int64), np.repeat(mark[own], n), np.full(len(s), dk), s + (th << 32)))
        if not found:
            return
        key, mark, dk, pos = (np.concatenate(x) for x in zip(*found))
        del found
        order, _, later = _order_and_firsts([mark, key], dk, pos)
        keep, gone = order[~later], order[later]
        yield from _emit(key[keep], mark[keep], dk[keep], pos[keep], np.zeros_like(pos[keep]), np.zeros(len(keep), dtype=np.int32), ITEM)
        yield from _emit_settled(dk[gone], pos[gone], np.full(len(gone), threshold))
        del key, mark, dk, pos, order, later, keep, gone
        c.trim()

    return run


def _last_digit(threshold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mark, dk, pos, cores, geo, kind = _load(batches)
        done = kind == SETTLED
        yield from _emit(key[done], mark[done], dk[done], pos[done], cores[done], geo[done], SETTLED)
        key, mark, dk, pos = (x[~done] for x in (key, mark, dk, pos))
        if len(dk):
            order, _, later = _order_and_firsts([key, mark], dk, pos)
            gone = order[later]
            yield from _emit_settled(dk[gone], pos[gone], np.full(len(gone), threshold))

    return run


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in c.chunks(batches, "text", 8 << 20):
        lo_hi = batch.column("spans")
        offsets = lo_hi.offsets.to_numpy()
        flat = lo_hi.flatten()
        los, lens = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        present = lo_hi.is_valid().to_numpy(zero_copy_only=False)
        base = offsets[0] if len(offsets) else 0
        kept, starts, ends = [], [], []
        for row, text in enumerate(c.text_bytes(batch.column("text"))):
            a, b = (offsets[row] - base, offsets[row + 1] - base) if present[row] else (0, 0)
            lo, hi = c.merge_spans(los[a:b], los[a:b] + lens[a:b])
            starts.append(lo.tolist())
            ends.append(hi.tolist())
            cuts = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2])) if len(lo) else text)
        columns = [batch.column("doc_id"), batch.column("text"), pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "kept", "span_start", "span_end"])


def _partitions(sample: DataFrame) -> list[int]:
    """How many tasks a radix pass needs, where that is more than the session's number of shuffle partitions."""
    size = (sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * SAMPLE
    tasks = -(-8 * size // (5 * TASK_BYTES))
    return [tasks] if tasks > int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


RESULT = "doc_id long, text string, kept binary, span_start array<long>, span_end array<long>"


def remove_repeats(docs: DataFrame, threshold: int = 100, finish: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = RESULT) -> DataFrame:
    """Remove every byte covered by a ``threshold``-byte string that also starts earlier in the corpus.

    Earlier: a smaller doc_id, or the same document at an earlier start.  A null doc_id orders first; rows that
    share a doc_id order by a hash of their text, and rows equal in both are one document.  A null text reads as
    empty.  Other columns of ``docs`` are not used.  Strings are judged on the input.

    Returns doc_id, text, kept (binary), span_start and span_end (maximal removed byte runs); ``finish`` takes batches
    of these to batches of ``schema`` in the same pass.  An empty table gives an empty result.
    """
    if threshold > 2000 or threshold < 2:
        raise ValueError("threshold must be between 2 and 2000 bytes")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").head(1)
    tie = F.pmod(F.xxhash64("text"), F.lit(2**31 - 1)).cast("long") if repeated else F.lit(0).cast("long")
    base = docs.select(c.doc_key().alias("dk"), tie.alias("th"), "text")
    item = "anchor long, full long, dk long, pos long, cores long, geo int, kind byte"
    sample = docs.select("text").filter(F.pmod(F.xxhash64("doc_id", F.lit("suffix sample")), F.lit(SAMPLE)) == 0)
    dealt = _partitions(sample)
    first = base.mapInArrow(_first_pass(threshold, hot_keys(sample, threshold)), item)
    judged = c.materialise(first.repartition(*dealt, "anchor").mapInArrow(_second_digit(threshold), item), "repeats")
    del first
    c.free_shuffles(docs.sparkSession)
    place = [F.col("dk"), F.shiftright("pos", 32).alias("th"), F.col("pos").bitwiseAND(F.lit(2**32 - 1)).alias("lo")]
    opens = judged.filter(F.col("kind") == OPEN).select(*place, "geo", "anchor").groupBy("dk", "th").agg(F.collect_list(F.struct("lo", "geo", "anchor")).alias("opens"))
    # both joins ask for the same exchange of the texts, which is made once
    windows = base.join(opens, ["dk", "th"], "left").select("dk", "th", "text", "opens").mapInArrow(_windows(threshold), item)
    edges = windows.repartition(*dealt, "anchor").mapInArrow(_last_digit(threshold), item)
    spans = judged.filter(F.col("kind") == SETTLED).unionByName(edges).select(*place, "geo").groupBy("dk", "th").agg(F.collect_list(F.struct("lo", "geo")).alias("spans"))
    cut = base.join(spans, ["dk", "th"], "left").select(c.original_id().alias("doc_id"), "text", "spans")
    return cut.mapInArrow((lambda batches: finish(_cut(batches))) if finish else _cut, schema)
