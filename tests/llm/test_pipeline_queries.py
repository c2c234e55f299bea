import hashlib
import itertools

import numpy as np
import public_tokenizers as P
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from spindrift.llm import bpe, language_id, queries

from .test_fm_index import WORD, brute as brute_hits
from .test_line_dedup import brute as brute_lines
from .test_simhash import classes, fingerprint


def test_every_query_is_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]


def test_contract_columns(spark, sf_dir):
    want = {
        "op1": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op2": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
        "op4": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op5": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op6": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op7": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
        "op8": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
        "op9": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op10": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    }
    for name, query in queries.QUERIES.items():
        df = query(spark, sf_dir)
        kinds = dict(df.dtypes)
        assert want.get(name.split("_")[0], {}).items() <= kinds.items(), name
        assert df.count() == spark.read.parquet(f"{sf_dir}/{'pages' if name.startswith('op1_') else 'documents'}.parquet").count()


def test_stages_take_odd_rows(spark, odd, nothing, sf_dir):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, sf_dir)
            assert got.columns == docs.columns and got.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_run_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in rows if r.text and language_id.has_letter(r.text.encode())]
    docs = [(d, kept) for (d, _), (_, _, kept) in zip(docs, brute_lines([t for _, t in docs], 10))]
    label = classes([fingerprint(t) for _, t in docs])
    first = {k: min(d for (d, _), c in zip(docs, label) if c == k) for k in set(label)}
    docs = [(d, t) for (d, t), c in zip(docs, label) if first[c] == d]
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(queries.tokenizer()[0]), special_tokens={})
    want = set()
    for d, t in docs:
        text = cut(t, items)
        ids = tik.encode_ordinary(text)
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def cut(text, items):
    """The text without its hit words and what lies between neighbouring ones."""
    if not brute_hits([(0, text)], items, 10)[0][2]:
        return text
    from .test_fm_index import LOWER

    words = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    hit = [False] * len(words)
    tokens = WORD.findall(text.translate(LOWER))
    for _, item in items:
        own = WORD.findall((item or "").translate(LOWER))
        for k in range(max(1, len(own) - 9)) if own else ():
            w = own[k : k + 10]
            for s in range(len(tokens) - len(w) + 1):
                if tokens[s : s + len(w)] == w:
                    hit[s : s + len(w)] = [True] * len(w)
    out, at = [], 0
    for flag, group in itertools.groupby(range(len(words)), key=lambda i: hit[i]):
        group = list(group)
        if flag:
            out.append(text[at : words[group[0]][0]])
            at = words[group[-1]][1]
    return "".join([*out, text[at:]])
