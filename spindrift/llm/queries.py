"""The queries opN_<name>: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fm_index, html_text, language_id, line_dedup, media, quality, simhash, suffix_dedup, toxicity
from . import common as c
from .oracles import ORACLES

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _digest_repeats(batches):
    for batch in batches:
        kept = batch.column("kept").to_pylist()
        lo, hi = (batch.column(n).to_pylist() for n in ("span_start", "span_end"))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(k) + sum(h) - sum(s) for k, s, h in zip(kept, lo, hi)], pa.int64()),
                pa.array([sum(h) - sum(s) for s, h in zip(lo, hi)], pa.int64()),
                pa.array([len(s) for s in lo], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(c.read_table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(c.read_table(spark, sf_dir, "documents"), 100, _digest_repeats, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (c.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    found = quality.assess(docs, quality.train(docs, labels), F.col("source"), F.concat_ws("/", "source", "lang"))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "evidence", "host_share", "path_share", "score", F.col("keep").cast("int").alias("predicted"), "keep")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read_table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (c.read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = fm_index.find_contamination(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "hits", "items").mapInArrow(_digest_hits, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _digest_hits(batches):
    for batch in batches:
        items = batch.column("items").to_pylist()
        hit = []
        for hits in batch.column("hits").to_pylist():
            lo, hi = fm_index.merged_hits(hits)
            hit.append(int((hi - lo).sum()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([n > 0 for n in hit], pa.bool_()),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def tokenizer() -> tuple[bytes, str]:
    return bpe.load_ranks(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN


def token_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encodes and decodes in one pass over the texts, so
    that a task has one worker and one set of learned states.  Null texts read as empty; other columns are not used."""
    vocabulary, pattern = tokenizer()
    data = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select("doc_id", "text").mapInArrow(_digest_tokens(data, pattern, bpe.disputed_characters(pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digest_tokens(data, pattern, disputed):
    def run(batches):
        codec = bpe.worker_codec(data, pattern, disputed)
        for batch in c.chunks(batches, "text", 1 << 20, keep="bpe"):
            n, encoded, decoded = [], [], []
            for ids in codec.encode_texts([text or "" for text in batch.column("text").to_pylist()]):
                n.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                whole = hashlib.sha256()
                for piece in codec.decode_stream(np.frombuffer(ids, dtype="<u4").tolist()):
                    whole.update(piece.encode("utf-8"))
                decoded.append(whole.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(c.read_table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_text(c.read_table(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return line_dedup.drop_common_lines(docs, min_docs=10).select("doc_id", "n_lines", "n_dropped", kept)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(c.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (c.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans")


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (op1_html_text, op2_suffix_dedup, op3_quality, op4_language_id, op5_decontamination, op6_byte_bpe, op7_media_columns, op8_line_dedup, op9_simhash, op10_toxicity)
}
