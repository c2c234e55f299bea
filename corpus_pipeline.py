"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Order: language identification (documents it rejects go), line dedup, SimHash near-dedup (the smallest doc_id of each
group stays), benchmark decontamination (hit words are cut out), byte-level BPE.  All but the last return the columns
of documents, with n_chars following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common, fm_index, language_id, line_dedup, queries, simhash


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang, with all of a row's columns but the text as one struct, so that no column meets an
    operator's own and texts move once."""
    return docs.select("doc_id", "text", "lang", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _unpacked(packed: DataFrame, docs: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of ``docs`` again; ``changed``: with the new text and its length."""
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if changed else {})
    return packed.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be determined, null and letterless texts among them; ``lang`` stays as
    given.  If nothing could be learned, all go."""
    found = language_id.predict(_packed(docs), language_id.train(docs))
    return _unpacked(found.filter(F.col("lang_pred") != language_id.UNDETERMINED), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten rows hold go; the rows stay, null texts as null, and so does an empty table."""
    return _unpacked(line_dedup.drop_common_lines(_packed(docs), min_docs=10), docs, changed=True)


#: Ids of documents that go are broadcast up to this many (some 16 MB); beyond, they are joined.
BROADCAST_IDS = 500_000


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document whose id names its component.  Rows without an id keep their place; of rows that share an
    id that stays, all stay.  Empty texts are near copies of each other."""
    found = simhash.near_duplicates(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    found = common.materialise(found, "near-copies")
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    return docs.join(found, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows go, and what lies between them; the rows stay, null texts as null."""
    items = common.read_table(spark, sf_dir, "benchmark")
    return _unpacked(fm_index.find_contamination(_packed(docs), items, remove=True), docs, changed=True)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of digests for each row; null texts read as empty."""
    return queries.token_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenise),
]

#: Language identification, XXH64 and byte-level BPE have no SQL form here; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
