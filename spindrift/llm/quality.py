"""Quality by hierarchical empirical Bayes.

A logistic classifier over a text's shape gives each document's evidence.  Documents lie on paths, paths on hosts:
the good share of each host is a posterior mean that shrinks towards the global share, that of each path towards its
host's.  The strengths of both priors come from the spread between groups (moments of grouped sums).  A document's
score joins its own evidence with the log-odds of its path against the global share, its own part of the sums left
out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c
from .language_id import held_out

#: Bounds of the labelled sample: documents of each label, and bytes of one text.
SAMPLE_DOCS = 2500
SAMPLE_BYTES = 1 << 16
KEEP = 0.5
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("0") : ord("9") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[[ord(x) for x in " \t\n\r\v\f"]] = 3
_CLASS[[ord(x) for x in ".,;:'\"-?"]] = 4
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:'\"-?"]] = 5
_CLASS[:9] = 5
_CLASS[[ord("!")]] = 6


def shape(text: bytes) -> list[float]:
    """Numbers between about 0 and 4 that describe a text's form."""
    words, lines = text.split(), text.split(b"\n")
    counts = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=7) / max(1, len(text))
    n, distinct = len(words), len(set(words))
    pairs = len(set(zip(words, words[1:])))
    sizes = [len(w) for w in words]
    return [
        1.0, np.log1p(n) / 3, distinct / max(1, n), pairs / max(1, n - 1) if n > 1 else 1.0, len(set(lines)) / len(lines),
        *(10 * np.minimum(counts[[1, 4, 5, 6]], 0.2)).tolist(), float(counts[2]) * 4, (sum(sizes) / max(1, n)) / 8, max(sizes, default=0) ** 0.5 / 8,
        float(n < 5), float(n < 20), min(1.0, len(lines) / max(1, n) * 5),
    ]


@dataclass
class Evidence:
    theta: np.ndarray
    prior: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return np.clip(np.array([shape(t) for t in texts]).reshape(len(texts), -1) @ self.theta, -8, 8)


def fit(texts: list[bytes], good: list[int], share: float) -> Evidence:
    """``share``: the good share among all labelled documents, which the sample does not have."""
    y = np.array(good, dtype=float)
    if not len(y) or y.min() == y.max():
        base = 2.0 if not len(y) or y.max() else -2.0
        theta = np.zeros(len(shape(b"")))
        theta[0] = base
        return Evidence(theta, base)
    x = np.array([shape(t) for t in texts])
    theta, ridge = np.zeros(x.shape[1]), 0.3 * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ theta)
        theta += move
        if np.abs(move).max() < 1e-8:
            break
    own = y.mean()
    prior = float(np.log(share / (1 - share)))
    theta[0] += prior - np.log(own / (1 - own))
    return Evidence(theta, prior)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Evidence:
    """Fits on at most about ``sample_docs`` documents of each label, chosen by a hash of doc_id among those that are
    not held out; of conflicting labels of one doc_id 0 counts."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("good")).filter(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("good").alias("good"))
    sizes = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    if not sizes:
        return fit([], [], 0.5)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 30)) / float(1 << 30)
    part = {k: min(1.0, sample_docs / n) for k, n in sizes.items()}
    chosen = known.withColumn("draw", draw).filter(F.col("draw") < F.when(F.col("good") == 1, part.get(1, 0.0)).otherwise(part.get(0, 0.0)))
    texts = docs.select("doc_id", "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("draw", "good", "text").toArrow()  # chosen is bounded by the sample
    rows = sorted(zip(rows.column("draw").to_pylist(), rows.column("good").to_pylist(), c.text_bytes(rows.column("text").combine_chunks())))
    return fit([t for _, _, t in rows], [k for _, k, _ in rows], sizes.get(1, 0) / sum(sizes.values()))


def _judged(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in c.chunks(batches, "text", 4 << 20):
            logits = model.logits(c.text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "host", "path")] + [pa.array(logits)], ["doc_id", "host", "path", "evidence"])

    return run


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior strength from the spread of group shares: beta moments over groups of two or more, between 2 and 500."""
    share = F.col("s") / F.col("n")
    r = groups.filter("n >= 2").agg(F.sum(F.col("n") * (share - mean) ** 2).alias("v"), F.sum("n").alias("n"), F.count("*").alias("g"), F.sum("q").alias("q")).first()
    if not r.g or r.n <= r.g:
        return 20.0
    within = max(r.q / r.n, 1e-9)  # average variance of a document's probability inside its group
    between = max(r.v / r.n - within * r.g / r.n, 1e-9)
    return float(min(500.0, max(2.0, within / between)))


def assess(docs: DataFrame, model: Evidence, host: Column, path: Column) -> DataFrame:
    """(doc_id, evidence, host_share, path_share, score, keep) of every row.

    ``host`` and ``path`` are columns over ``docs``; nulls are groups of their own.  Null and empty texts are judged by
    their shape like any other.  Sums over groups are aggregated before the shuffle; a host with a third of all rows
    sends one partial sum from each task, and rows meet the sums without their texts, those of hot paths in place.
    An empty table gives an empty result; other columns are not used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    own = c.materialise(own.mapInArrow(_judged(shared), "doc_id long, host string, path string, evidence double").withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("p2")]
    paths = c.materialise(own.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("p2").alias("p2"))
    spread = (F.col("p2") - F.col("s") ** 2 / F.col("n")).alias("q")
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = float(total.s / total.n) if total.n else 0.5
    k_host = _strength(hosts.select("n", "s", spread), mean)
    k_path = _strength(paths.select("n", "s", spread), mean)
    sums = paths.select("host", "path", F.col("n").alias("pn"), F.col("s").alias("ps")).join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host")
    joined = c.join_sums(own, c.materialise(sums, "path-sums"), ["host", "path"], "pn", int(total.n or 0))
    host_share = (F.col("hs") - F.col("p") + k_host * mean) / (F.col("hn") - 1 + k_host)
    path_share = (F.col("ps") - F.col("p") + k_path * F.col("host_share")) / (F.col("pn") - 1 + k_path)
    out = joined.withColumn("host_share", host_share).withColumn("path_share", path_share)
    logit = F.col("evidence") + 0.5 * (_logit(F.col("path_share")) - _logit(F.lit(mean)))
    out = out.withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "evidence", "host_share", "path_share", "score", (F.col("score") >= KEEP).alias("keep"))
