"""Toxic spans by a linear-chain conditional random field.

Labels are of documents.  Words of documents labelled toxic become labelled tokens where some feature of theirs (the
word itself or a prefix) marks toxic documents; the field (two states, word features, transitions) is fitted to these
tokens by gradient ascent with forward-backward.  A document's score is a logistic function, fitted to the document
labels, of its tokens' marginals; spans of tokens with high marginals are the offending offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .language_id import held_out

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PREFIXES = (4, 5, 6)
#: Bounds of the labelled sample: documents of each label, and bytes of one text.
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 1 << 15
#: A feature marks toxic documents at this log-odds, in two texts that are no near copies of each other, and so often
#: that fewer than CHANCE of all features (some hundred thousand) would be in toxic documents alone so often by chance.
MARKED, CHANCE = 2.5, 10.0
#: A training document is a near copy if so much of its word runs of COPY_WORDS was seen in others.  Copies of a text
#: are evidence with this correlation: m of them count as m / (1 + (m - 1) COPY_CORRELATION) documents.
COPY_WORDS, COPY_SHARE, COPY_CORRELATION = 5, 0.3, 0.25
MAX_WORDS = 300_000
THRESHOLD = 0.3


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def features(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Crf:
    """Log-odds form: state 1 is toxic; ``step[i, j]`` is the score of moving from state i to state j."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -4.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))

    def emission(self, word: bytes) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(toxic) of every token; documents lie one after another and are swept in lockstep, the longest first."""
        return forward_backward(emissions, lengths, self.step)[0]


def forward_backward(e: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token marginals and expected transition counts.  Messages are log-odds of the two states."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")  # documents with more than t tokens
    forward, backward = np.empty(len(e)), np.zeros(len(e))
    w = np.exp(step)

    def across(x, matrix):
        g = np.exp(np.clip(x, -60, 60))
        return np.log((matrix[0, 1] + matrix[1, 1] * g) / (matrix[0, 0] + matrix[1, 0] * g))

    x = None
    for t in range(steps):
        at = starts[: live[t]] + t
        x = e[at] if t == 0 else e[at] + across(x[: live[t]], w)
        forward[at] = x
    x = np.zeros(0)
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        at = starts[:n] + t
        after = np.zeros(n)
        after[: len(x)] = x
        x = across(after + e[at + 1], w.T)
        backward[at] = x
    marginal = 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))
    moves = np.zeros((2, 2))
    first = np.zeros(len(e), dtype=bool)
    first[starts[lengths > 0]] = True
    to = np.flatnonzero(~first)
    if len(to):
        a, b = forward[to - 1], backward[to] + e[to]
        score = np.stack([step[0, 0] + 0 * a, step[0, 1] + b, step[1, 0] + a, step[1, 1] + a + b])
        score = np.exp(score - score.max(axis=0))
        moves = (score / score.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return marginal, moves


def _coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, the word numbers of all texts one after another, and the texts' lengths in words."""
    number: dict[bytes, int] = {}
    own = [np.array([number.setdefault(w, len(number)) for w in tokens(t)], dtype=np.int64) for t in texts]
    return list(number), np.concatenate([np.zeros(0, dtype=np.int64), *own]), np.array([len(x) for x in own], dtype=np.int64)


def _copies(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document the first one that it is a near copy of (itself, for most), and which tokens lie outside
    passages that earlier documents have: copies would make any rare word of theirs look like a mark of their label."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.repeat(lengths, lengths) - at
    run = np.zeros(len(ids), dtype=np.uint64)
    for k in range(COPY_WORDS):  # shorter at a document's end
        word = np.where(left > k, np.roll(ids, -k) + 1, 0).astype(np.uint64)
        run = (run ^ word) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(29)
    _, first, group = np.unique(run, return_index=True, return_inverse=True)
    source = doc[first][group]  # the first index is the earliest document's
    new = source == doc
    whole = (left >= COPY_WORDS) | (at == 0)
    n_new = np.bincount(doc[whole & new], minlength=len(lengths))
    n_runs = np.bincount(doc[whole], minlength=len(lengths))
    root = np.arange(len(lengths))
    ends = np.cumsum(lengths)
    for d in np.flatnonzero(n_new < (1 - COPY_SHARE) * n_runs).tolist():
        own = source[ends[d] - lengths[d] : ends[d]]
        own = own[own < d]
        root[d] = root[np.bincount(own).argmax()]
    return root, new


def _marks(vocabulary: list[bytes], ids: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All features, those of each word one after another with the words' numbers, and which mark toxic documents.

    Each group of near copies with one label counts once, by its first text, with the weight of COPY_CORRELATION."""
    root, new = _copies(ids, lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    weight = np.bincount(root[y == y[root]], minlength=len(lengths)).astype(float)
    weight /= 1 + np.maximum(weight - 1, 0) * COPY_CORRELATION
    kept = root == np.arange(len(lengths))
    pair = np.unique((doc * (len(vocabulary) + 1) + ids)[new & kept[doc]])
    pair_doc, pair_word = pair // (len(vocabulary) + 1), pair % (len(vocabulary) + 1)
    names: dict[bytes, int] = {}
    owned = [[names.setdefault(f, len(names)) for f in features(w)] for w in vocabulary]
    flat = np.array([f for some in owned for f in some], dtype=np.int64)
    size = np.array([len(some) for some in owned], dtype=np.int64)
    start = np.cumsum(size) - size
    wide = np.repeat(start[pair_word] - (np.cumsum(size[pair_word]) - size[pair_word]), size[pair_word])
    feature = flat[np.arange(len(wide)) + wide]
    once = np.unique(np.repeat(pair_doc, size[pair_word]) * (len(names) + 1) + feature)
    hit_doc, hit = once // (len(names) + 1), once % (len(names) + 1)
    bad = y[hit_doc] > 0
    texts = np.bincount(hit[bad], minlength=len(names))
    in_toxic = np.bincount(hit[bad], weights=weight[hit_doc][bad], minlength=len(names))
    in_clean = np.bincount(hit[~bad], weights=weight[hit_doc][~bad], minlength=len(names))
    n1, n0 = max(1e-9, weight[kept & (y > 0)].sum()), max(1e-9, weight[kept & (y == 0)].sum())
    with np.errstate(divide="ignore"):
        odds = np.log((in_toxic / n1) / ((in_clean + 0.5) / n0))
    # a feature that says nothing is in k toxic documents and in no clean one with probability p ** k, p their share;
    # one of clean documents too must be in more toxic ones than that many clean ones let expect
    p = n1 / (n1 + n0)
    chance = np.count_nonzero(texts) * p ** (in_toxic - in_clean * p / (1 - p)) if n0 > 1e-9 else np.full(len(names), np.inf)
    strong = (odds >= MARKED) | ((in_clean == 0) & (in_toxic > 0))
    return list(names), flat, np.repeat(np.arange(len(vocabulary)), size), strong & (texts >= 2) & (chance < CHANCE)


def fit(texts: list[bytes], toxic: list[int], share: float | None = None, rounds: int = 40) -> Crf:
    """Fits the field and the calibration to labelled documents; near copies are weighted only where features are
    chosen.  ``share``: the toxic share of all labelled documents, where the sample has another.  Without marks every
    text scores the labelled share."""
    vocabulary, ids, lengths = _coded(texts)
    y = np.array(toxic, dtype=float)
    names, flat, owner, marks = _marks(vocabulary, ids, lengths, y)
    crf = Crf()
    if marks.any():
        dense = np.cumsum(marks) - 1
        owner = owner[marks[flat]]
        flat = dense[flat[marks[flat]]]
        labels = [f for f, m in zip(names, marks) if m]
        crf = _ascend(ids, lengths, y, flat, owner, labels, len(vocabulary), rounds)
    emission = np.array([crf.emission(w) for w in vocabulary])
    marginal = crf.marginals(emission[ids], lengths) if len(ids) else np.zeros(0)
    parts = np.split(marginal, np.cumsum(lengths)[:-1]) if len(lengths) else []
    x = np.array([summary(m) for m in parts]).reshape(-1, 2) * marks.any()
    crf.calibration = _logistic(x, y)
    if share and 0 < share < 1 and len(y) and 0 < y.mean() < 1:
        crf.calibration[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return crf


def _ascend(ids: np.ndarray, lengths: np.ndarray, y: np.ndarray, flat: np.ndarray, owner: np.ndarray, names: list[bytes], n_words: int, rounds: int) -> Crf:
    """Gradient ascent on the field's likelihood.  Word ``owner[i]`` has feature ``flat[i]``; a token of a toxic
    document is labelled toxic if its word has any."""
    crf = Crf()
    is_marked = np.zeros(n_words, dtype=bool)
    is_marked[owner] = True
    target = is_marked[ids] & np.repeat(y > 0, lengths)
    first = np.zeros(len(ids), dtype=bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    seen_moves = np.zeros((2, 2))
    to = np.flatnonzero(~first)
    np.add.at(seen_moves, (target[to - 1].astype(int), target[to].astype(int)), 1)
    weights, bias, step = np.zeros(len(names)), crf.bias, crf.step.copy()
    squares, bias_square, step_square = np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    per_word = np.bincount(ids, weights=target, minlength=n_words)
    for _ in range(rounds):
        emission = bias + np.bincount(owner, weights=weights[flat], minlength=n_words)
        marginal, moves = forward_backward(emission[ids], lengths, step)
        gap = per_word - np.bincount(ids, weights=marginal, minlength=n_words)
        grad = np.bincount(flat, weights=gap[owner], minlength=len(names)) - 0.5 * weights
        squares += grad**2
        weights += 0.7 * grad / np.sqrt(squares)
        grad = gap.sum()
        bias_square += grad**2
        bias += 0.7 * grad / np.sqrt(bias_square)
        grad = seen_moves - moves - 0.5 * step
        step_square += grad**2
        step += 0.3 * grad / np.sqrt(step_square)
    return Crf({f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-3}, float(bias), step)


def _per_document(crf: Crf, words: list[list[bytes]], cache: dict | None = None) -> list[np.ndarray]:
    cache = _Emissions(crf) if cache is None else cache
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    e = np.fromiter((cache[w] for own in words for w in own), dtype=np.float64, count=int(lengths.sum()))
    marginal = crf.marginals(e, lengths)
    return np.split(marginal, np.cumsum(lengths)[:-1]) if len(lengths) else []


def summary(marginals: np.ndarray) -> tuple[float, float]:
    """What a score is made of: the log of one plus the expected number of toxic tokens, and the surest token."""
    return (float(np.log1p(marginals.sum())), float(marginals.max())) if len(marginals) else (0.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Newton's method with a small ridge; both labels weigh alike up to a factor that keeps odd labels from ruling."""
    design = np.hstack([np.ones((len(x), 1)), x])
    theta = np.zeros(design.shape[1])
    if not len(x) or y.min() == y.max():
        theta[0] = -3.0 if not len(x) or not y.max() else 3.0
        return theta
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (y - p) - 0.1 * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(len(theta))
        move = np.linalg.solve(hessian, grad)
        theta += move
        if np.abs(move).max() < 1e-8:
            break
    return theta


class _Emissions(dict):
    def __init__(self, crf: Crf):
        super().__init__()
        self.crf = crf

    def __missing__(self, word: bytes) -> float:
        value = self.crf.emission(word)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = value
        return value


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Crf:
    """Fits on at most about ``sample_docs`` documents of each label, chosen by a hash of doc_id among those that are
    not held out; of conflicting labels of one doc_id 1 counts, and rows that share a doc_id share its label.  Without
    labels every text scores alike and low."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes:
        return fit([], [])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) / float(1 << 30)
    share = {k: min(1.0, sample_docs / n) for k, n in sizes.items()}
    chosen = known.withColumn("draw", draw).filter(F.col("draw") < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    texts = docs.select("doc_id", "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("draw", "toxic", "text").toArrow()  # chosen is bounded by the sample
    rows = sorted(zip(rows.column("draw").to_pylist(), rows.column("toxic").to_pylist(), c.text_bytes(rows.column("text").combine_chunks())))
    return fit([t for _, _, t in rows], [k for _, k, _ in rows], sizes.get(1, 0) / sum(sizes.values()))


def _scored(shared, with_spans: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        cache = _Emissions(crf)
        theta = crf.calibration
        for batch in c.chunks(batches, "text", 4 << 20):
            texts = c.text_bytes(batch.column("text"))
            marginals = _per_document(crf, [tokens(t) for t in texts], cache)
            x = np.array([(1.0, *summary(m)) for m in marginals])
            score = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            spans = [_spans(t, m) if with_spans and len(m) and m.max() >= 0.5 else [] for t, m in zip(texts, marginals)]
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(spans, kind)], [*batch.schema.names, "score", "spans"])

    return run


def _spans(text: bytes, marginals: np.ndarray) -> list[dict]:
    """Runs of tokens with marginals of a half or more, as character offsets of the text."""
    places = [m.span() for m in WORD.finditer(text)]
    hot = np.flatnonzero(np.diff(np.concatenate([[0], (marginals >= 0.5).astype(np.int8), [0]])))
    out = []
    for a, b in zip(hot[::2], hot[1::2]):
        lo, hi = (len(text[:x].decode("utf-8")) for x in (places[a][0], places[b - 1][1]))
        out.append({"lo": lo, "hi": hi, "p": float(marginals[a:b].max())})
    return out


def score(docs: DataFrame, crf: Crf, with_spans: bool = True) -> DataFrame:
    """The columns of ``docs`` and score and spans (lo, hi in characters, p), which replace columns of those names.

    Only ``text`` is looked at, the whole of it.  Null and empty texts have no tokens and score the calibration's base.
    """
    docs = docs.drop("score", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    return docs.mapInArrow(_scored(shared, with_spans), f"{schema}, score double, spans array<struct<lo: bigint, hi: bigint, p: double>>")
