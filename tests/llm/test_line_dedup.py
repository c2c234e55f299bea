from collections import Counter

from spindrift.llm import line_dedup as L


def brute(texts, least):
    lines = [(t or "").split("\n") for t in texts]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    n = Counter(k for own in lines for k in {key(x) for x in own} if k)
    return [(len(own), sum(n[key(x)] >= least for x in own if key(x)), "\n".join(x for x in own if not key(x) or n[key(x)] < least)) for own in lines]


def test_both_ways_equal_brute_force(spark):
    texts = [f"Head \n{i % 7}\n\n  head\tx\nÉcole\nunique {i}" for i in range(40)] + [None, "", "HEAD", "\n\n", "école"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    want = {i: w for i, w in enumerate(brute(texts, 6))}
    for limit in (10**6, 0):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in L.drop_common_lines(docs, 6, broadcast_lines=limit).collect()}
        assert got == want


def test_runs_are_levelled_and_compacted(spark):
    store = L.LineRuns(spark, 10, fanout=2)
    for k in range(5):
        store.add(spark.createDataFrame([(f"a\nonly {k}",), ("a\na\nb",)], "text string"))
    assert [len(level) for level in store.levels] == [1, 0, 1]  # 5 = 4 + 1
    counts = Counter(r.n for r in L._sums(L._all([run for level in store.levels for run in level])).collect())
    assert counts == {10: 1, 5: 1, 1: 5}
    got = store.strip(spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string"))
    assert got.first().text == "b\nc"


def test_each_batch_is_joined_with_the_settled_runs(spark):
    """Lines that compaction settles are not counted again, and no line is lost, whichever batches hold it."""
    store = L.LineRuns(spark, 3, fanout=2)
    for k, batch in enumerate([["a", "a"], ["a", "b"], ["a", "b", "c"], ["a"], ["a", "c", "b"], ["c", "d"], ["d"]]):
        store.add(spark.createDataFrame([(x,) for x in batch], "text string"))
        if k == 4:
            assert len(store.settled) == 3 and sum(store.levels[0][0].toPandas().n) == 2  # a is settled, b and c count
    frequent = L._halves(L._digests([b"a", b"b", b"c"])).tolist()
    assert sorted([r.h1, r.h2] for r in store.frequent().distinct().collect()) == sorted(frequent)


def test_more_batches_than_fanout(spark):
    texts = [f"often\n{'rare' if i % 9 == 0 else i}\nx{i % 5}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    want = {i: w for i, w in enumerate(brute(texts, 10))}
    for n_batches, fanout in ((1, 4), (7, 2), (12, 3)):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in L.drop_common_lines(docs, 10, n_batches, fanout=fanout).collect()}
        assert got == want


def test_rows_count_as_documents(spark):
    rows = [(1, "twice\na")] * 5 + [(None, "twice\nb")] * 5 + [(2, "nine")] * 9
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, dk int, th int, dropped_lines int")
    for limit in (10**6, 0):
        got = Counter((r.doc_id, r.text, r.n_dropped, r.dk) for r in L.drop_common_lines(docs, 10, broadcast_lines=limit).collect())
        assert got == {(1, "a", 1, 1): 5, (None, "b", 1, 1): 5, (2, "nine", 0, 1): 9}


def test_odd_rows(odd, nothing):
    for limit in (10**6, 0):
        got = L.drop_common_lines(odd, 3, broadcast_lines=limit)
        assert got.count() == odd.count() and got.columns.count("n_lines") == 1 and dict(got.dtypes)["n_lines"] == "bigint"
        assert {r.text for r in got.filter("doc_id = 1").collect()} == {None}
        assert got.filter("doc_id = 2").first().n_lines == 1
        assert L.drop_common_lines(nothing, 3, broadcast_lines=limit).count() == 0
