"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1.  For each code bit a binary classifier over hashed byte n-grams (log-odds
of the n-gram on the two sides, averaged over a text, scaled by a fitted slope) gives a margin; decoding takes the
codeword with the least logistic loss over the margins and flags texts whose two best codewords are close.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

UNDETERMINED = "und"
GRAMS = (2, 3, 4)
BUCKETS = 1 << 15
#: Bounds of the labelled sample that the classifiers are fitted on: texts in all, bytes of one text, and languages, of
#: which the most frequent ones are learned.
SAMPLE_TEXTS = 2400
SAMPLE_BYTES = 1 << 16
MAX_LANGUAGES = 500
#: Texts are scored together up to BATCH_BYTES; longer texts than LONG_BYTES are scored by counts.
BATCH_BYTES, LONG_BYTES = 1 << 18, 1 << 17
AMBIGUOUS = 0.2
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = re.compile(r"[^\W\d_]")


def held_out(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return any(ch.isalpha() for ch in text.decode("utf-8", "ignore")) if not text.isascii() else False


def gram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte."""
    key = np.zeros(max(len(data) - n + 1, 0), dtype=np.uint32)
    for k in range(n):
        key = key * np.uint32(257) + data[k : k + len(key)]
    key = (key + np.uint32(n)) * np.uint32(2654435761)
    return (key >> np.uint32(32 - 15)).astype(np.int32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +-1.  Up to five languages: the exhaustive code; beyond: the best of some random codes, whose columns
    all tell other sets of languages apart: none repeats, mirrors another or has one side only."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        columns = [[1] + [1 if column >> k & 1 else -1 for k in range(n - 1)] for column in range(2 ** (n - 1) - 1)]
        return np.array(columns, dtype=np.int8).T
    width, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None
    for _ in range(64):
        drawn = rng.choice(np.array([-1, 1], dtype=np.int8), (n, 8 * width))
        drawn = np.unique(drawn * drawn[0], axis=1)  # the first language is always on the same side
        drawn = drawn[:, np.abs(drawn.sum(axis=0)) < n]
        code = drawn[:, rng.permutation(drawn.shape[1])[:width]]
        width = code.shape[1]
        inner = code.astype(np.int32) @ code.T
        far = (width - inner[~np.eye(n, dtype=bool)].max()) // 2
        if best is None or far > best[0]:
            best = (far, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    intercept: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Average log-odds of each text's n-grams for each code bit."""
        total = np.zeros((len(texts), self.weights.shape[1]), dtype=np.float64)
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)  # each text with one break before it
        short = [k for k, n in enumerate(lengths) if n <= LONG_BYTES]
        if short:
            total[short] = self._together([texts[k] for k in short], lengths[short])
        for k in np.flatnonzero(lengths > LONG_BYTES).tolist():  # by counts of buckets, in memory of a few bytes a gram
            data = np.frombuffer(b"\n" + texts[k].lower() + b"\n" * (max(GRAMS) - 1), dtype=np.uint8)
            for n in GRAMS:
                total[k] += np.bincount(gram_buckets(data, n)[: lengths[k]], minlength=BUCKETS) @ self.weights
        return total / (len(GRAMS) * lengths[:, None])

    def _together(self, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        gap = b"\n" * (max(GRAMS) - 1)  # no gram that starts in a text reaches the next one
        data = np.frombuffer(gap.join([b"", *(t.lower() for t in texts), b"\n"]), dtype=np.uint8)
        starts = len(gap) - 1 + np.cumsum(lengths - 1 + len(gap)) - (lengths - 1 + len(gap))
        bounds = np.stack([starts, starts + lengths], axis=1).ravel()
        return sum(np.add.reduceat(self.weights[gram_buckets(data, n)], bounds, axis=0)[::2].astype(np.float64) for n in GRAMS)

    def decode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the language number, its share of the codewords' likelihood, and whether it is ambiguous."""
        z = self.margins(texts) * self.slope + self.intercept
        evidence = np.minimum(np.sqrt([len(t) for t in texts]), 40)[:, None] * z
        loss = np.logaddexp(0, -evidence[:, None, :] * self.code[None]).sum(axis=2)
        loss -= loss.min(axis=1, keepdims=True)
        share = np.exp(-loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = np.sort(share, axis=1)
        close = top[:, -1] - top[:, -2] < AMBIGUOUS if share.shape[1] > 1 else np.zeros(len(best), dtype=bool)
        return best, share[np.arange(len(best)), best], close


def fit(texts: list[bytes], labels: list[str]) -> Model:
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in labels], dtype=np.int64)
    code = codewords(len(languages))
    counts = np.zeros((len(languages), BUCKETS))
    for text, k in zip(texts, y):
        data = np.frombuffer(b"\n" + text.lower() + b"\n", dtype=np.uint8)
        for n in GRAMS:
            counts[k] += np.bincount(gram_buckets(data, n), minlength=BUCKETS) / max(len(data), 200)
    counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1] if len(languages) > 1 else 0):
        sides = [counts[code[:, bit] == s].mean(axis=0) + 1e-5 for s in (1, -1)]
        weights[:, bit] = np.log(sides[0]) - np.log(sides[1])
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.zeros(code.shape[1]))
    if len(languages) > 1:
        z, target = model.margins(texts), code[y].astype(float)
        for bit in range(code.shape[1]):
            model.slope[bit], model.intercept[bit] = _line(z[:, bit], target[:, bit])
    return model


def _line(z: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that separate the sides' means at +-1."""
    up, down = z[target > 0].mean(), z[target < 0].mean()
    slope = 2 / max(up - down, 1e-6)
    return slope, -slope * (up + down) / 2


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Model | None:
    """Fits on at most about ``sample_texts`` labelled texts of at most SAMPLE_BYTES, spread evenly over languages and
    chosen by a hash of doc_id among documents that are not held out.  None if there are none."""
    known = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.filter(F.octet_length("text") <= SAMPLE_BYTES)
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return None
    quota = max(1, sample_texts // len(sizes))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 1.1 * quota / size)) for lang, size in sizes.items()], "lang string, share double")
    rows = known.withColumn("draw", draw).join(F.broadcast(shares), "lang").filter("draw < share").select("lang", "draw", "text").toArrow()  # shares: a row for each language
    rows = sorted(zip(rows.column("lang").to_pylist(), rows.column("draw").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist()))
    kept, seen = [], dict.fromkeys(sizes, 0)
    for lang, _, text in rows:
        if seen[lang] < quota and has_letter(text):
            seen[lang] += 1
            kept.append((text, lang))
    return fit([t for t, _ in kept], [x for _, x in kept]) if kept else None


def _predicted(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in c.chunks(batches, "text", BATCH_BYTES):
            texts = c.text_bytes(batch.column("text"))
            lang, score, close = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            some = [k for k, t in enumerate(texts) if has_letter(t)]
            if model is not None and some:
                best, own, near = model.decode([texts[k] for k in some])
                score[some], close[some] = own, near
                for k, b in zip(some, best):
                    lang[k] = model.languages[b]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(close)], [*names, "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` and lang_pred, score (0 to 1) and ambiguous, which replace columns of those names.

    Only ``text`` is looked at.  A null text and one without a letter are ``und`` with score 0, and so is every text
    if nothing could be learned.  Null ids, repeated rows and an empty table give a row for each row; texts of any
    length are scored whole, long ones by counts of their n-grams.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predicted(shared), f"{schema}, lang_pred string, score double, ambiguous boolean")
