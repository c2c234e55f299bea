import random

import pytest

from spindrift.llm import suffix_dedup as S


def brute(docs, threshold):
    """docs: (id, bytes) in order; (id, kept, spans)."""
    seen, out = set(), []
    for name, data in docs:
        gone = bytearray(len(data))
        for s in range(len(data) - threshold + 1):
            w = data[s : s + threshold]
            if w in seen:
                gone[s : s + threshold] = b"\1" * threshold
            seen.add(w)
        spans, start = [], None
        for i, g in enumerate([*gone, 0]):
            if g and start is None:
                start = i
            if not g and start is not None:
                spans.append((start, i))
                start = None
        out.append((name, bytes(b for b, g in zip(data, gone) if not g), spans))
    return out


def found(df):
    return sorted((r.doc_id, bytes(r.kept), list(zip(r.span_start, r.span_end))) for r in df.collect())


@pytest.mark.parametrize("threshold", [5, 40, 100])
def test_against_brute_force(spark, threshold):
    rng = random.Random(threshold)
    shared = ["".join(rng.choice("ab c") for _ in range(rng.randrange(threshold // 2, 3 * threshold))) for _ in range(6)]
    docs = [(i, "".join(rng.choice([*shared, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, threshold)))]) for _ in range(6))) for i in range(60)]
    docs += [(60, "a" * (4 * threshold)), (61, docs[3][1]), (62, ""), (63, "x" * (threshold - 1)), (64, "xy" * threshold)]
    got = found(S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), threshold))
    assert got == brute([(i, t.encode()) for i, t in docs], threshold)


def test_long_text_is_cut_into_slices(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh") for _ in range(1_300_000))
    text = base + base[200_000:200_500] + "Q" + base[1_048_500:1_048_700]
    got = found(S.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got[0][2] == [(1_300_000, 1_300_500), (1_300_501, 1_300_701)]


def test_odd_rows(spark, odd, nothing):
    got = S.remove_repeats(odd)
    assert got.columns == ["doc_id", "text", "kept", "span_start", "span_end"] and got.count() == odd.count()
    rows = [(r.doc_id, len(r.text or ""), len(r.kept)) for r in got.collect()]
    fours = sorted(r for r in rows if r[0] == 4)
    assert len({r for r in fours if r[1] == fours[0][1]}) == 1  # equal rows are one document
    assert [r[2] for r in rows if r[0] == 5] == [0]  # all of it is in document 4
    assert all(r[2] == 0 for r in rows if r[1] == 0)
    assert S.remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeats(odd, 1)


def test_hot_anchors_are_spread(spark, monkeypatch):
    """A phrase below the threshold in a third of all documents, each time in other surroundings, and one just below it:
    no key is left with many contents, and the result is that of brute force."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrase, longer, copied = word(60), word(95), word(150)
    docs = [(i, word(80) + (phrase if i % 3 == 0 else longer if i % 3 == 1 else copied if i % 9 == 2 else "") + word(80)) for i in range(900)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(S, "SAMPLE", 2)
    hot = S.hot_keys(table, 100)
    assert 0 < len(hot) < 50
    batch = pa.RecordBatch.from_pydict({"dk": [i for i, _ in docs], "th": [0] * len(docs), "text": [t for _, t in docs]})
    most = []
    for known in (hot[:0], hot):
        items = pa.Table.from_batches(list(S._first_pass(100, known)([batch]))).to_pandas()
        most.append(items[items.kind == S.ITEM].groupby("anchor").full.nunique().max())
    assert most[0] > 250 and most[1] < 30
    assert found(S.remove_repeats(table, 100)) == brute([(i, t.encode()) for i, t in docs], 100)


def test_partitioning_does_not_matter(spark, odd):
    key = lambda df: sorted((str(r.doc_id), bytes(r.kept)) for r in df.collect())
    assert key(S.remove_repeats(odd.repartition(7), 20)) == key(S.remove_repeats(odd.repartition(1), 20))
