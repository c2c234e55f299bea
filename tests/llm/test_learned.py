import numpy as np
import pytest

from spindrift.llm import language_id as L
from spindrift.llm import quality as Q
from spindrift.llm import toxicity as T
from pyspark.sql import functions as F


# ---- language


def test_codewords():
    for n in (2, 3, 4, 5, 9):
        code = L.codewords(n)
        far = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert far >= (2 ** (n - 2) if n <= 5 else code.shape[1] // 4)
    for n in (6, 7, 12, 30):
        code = L.codewords(n) * L.codewords(n)[0]
        assert len(np.unique(code, axis=1).T) == code.shape[1] >= min(2 ** (n - 1) - 1, int(10 * np.log2(n))) and (np.abs(code.sum(axis=0)) < n).all()


def test_learned_languages_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.predict(docs, L.train(docs))
    held = found.filter(L.held_out())
    assert held.filter("lang = lang_pred").count() / held.count() > 0.97
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_odd_rows(spark, odd, nothing):
    model = L.fit([b"the and of", b"der die und"] * 5, ["en", "de"] * 5)
    got = {(r.doc_id, r.n_chars): r for r in L.predict(odd, model).collect()}
    assert got[1, None].lang_pred == "und" and got[7, 1].lang_pred == "und" and got[6, 1].lang_pred == "und" and got[8, 1].lang_pred != "und"
    assert L.train(nothing) is None and {r.lang_pred for r in L.predict(odd, None).collect()} == {"und"}
    assert L.predict(nothing, model).count() == 0
    only = L.fit([b"the", b"of"], ["en", "en"])
    assert [x.lang_pred for x in L.predict(spark.createDataFrame([("hello",)], "text string"), only).collect()] == ["en"]


def test_ambiguous_texts_are_flagged():
    model = L.fit([b"the and of to", b"der die und zu"] * 20, ["en", "de"] * 20)
    _, share, close = model.decode([b"qq", b"the and of to the and of", b"der die und zu"])
    assert close[0] and not close[1] and not close[2] and share[1] > 0.8


# ---- toxicity


def test_margins_do_not_depend_on_neighbours():
    model = L.fit([b"the cat and the dog " * 9, b"der hund und die katze " * 9], ["en", "de"])
    model.weights = np.random.default_rng(0).normal(size=model.weights.shape).astype(np.float32)
    texts = [b"a", b"the", b"", b"a", b"und die", b"a", b"the"]
    alone = np.concatenate([model.margins([t]) for t in texts])
    assert np.allclose(model.margins(texts), alone) and np.allclose(model.margins(texts[::-1]), alone[::-1])


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, step = rng.normal(size=7), rng.normal(size=(2, 2))
    lengths = np.array([3, 0, 4])
    marginal, moves = T.forward_backward(e, lengths, step)
    at, want, pairs = 0, [], np.zeros((2, 2))
    for n in lengths:
        own = e[at : at + n]
        at += n
        total, hot = 0.0, np.zeros(n)
        both = np.zeros((2, 2))
        for k in range(2**n):
            y = [k >> i & 1 for i in range(n)]
            w = np.exp(sum(own[i] for i in range(n) if y[i]) + sum(step[a, b] for a, b in zip(y, y[1:])))
            total += w
            hot += w * np.array(y, dtype=float)
            for a, b in zip(y, y[1:]):
                both[a, b] += w
        want += (hot / total).tolist() if n else []
        pairs += both / total if n else 0
    assert marginal == pytest.approx(want) and moves == pytest.approx(pairs)


def test_toxic_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = T.score(docs.select("doc_id", "text"), T.train(docs, labels)).join(labels, "doc_id").filter(L.held_out())
    n = {(r.toxic, r.hit): r["count"] for r in scored.groupBy("toxic", (F.col("score") >= T.THRESHOLD).alias("hit")).count().collect()}
    assert n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0)) > 0.85
    assert n.get((0, True), 0) / (n.get((0, True), 0) + n.get((0, False), 0)) < 0.02


def test_spans_and_odd_rows(spark, odd, nothing):
    clean, bad = [b"an apple a day, what you are today he is"] * 40, [b"you are an idiot today", b"what an IDIOT he is"] * 10
    crf = T.fit([*clean, *bad], [0] * 40 + [1] * 20)
    r = T.score(spark.createDataFrame([("é so an Idiot, yes",)], "text string"), crf).first()
    assert r.score > 0.5 and [("é so an Idiot, yes")[s.lo : s.hi] for s in r.spans] == ["Idiot"]
    got = T.score(odd, crf)
    assert got.count() == odd.count() and dict(got.dtypes)["score"] == "double" and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert got.filter("doc_id = 1").first().score == got.filter("doc_id = 2").first().score < 0.3
    assert T.score(nothing, crf).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(odd, T.train(odd, none)).filter("score >= 0.3").count() == 0


def test_templates_and_copies():
    """Labels of a few templates: their shared mark is learned, words of one template alone are not; where nothing
    marks, every text scores the labelled share."""
    clean = [f"please find the {x} report attached" .encode() for x in ("weekly", "monthly")] * 200
    bad = [b"only a zorkling would say so", b"such zorkling nonsense again"] * 30
    crf = T.fit([*clean, *bad], [0] * 400 + [1] * 60)
    assert set(crf.weights) and {w.lstrip(b"=")[:4] for w in crf.weights} == {b"zork"}
    crf = T.fit([b"the same words every time"] * 80 + [b"the same words every time"] * 20, [0] * 80 + [1] * 20, 0.2)
    score = 1 / (1 + np.exp(-crf.calibration @ [1.0, *T.summary(T._per_document(crf, [T.tokens(b"any words at all")])[0])]))
    assert not crf.weights and score == pytest.approx(0.2, abs=0.02)


# ---- quality


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = Q.assess(docs, Q.train(docs, labels), F.col("source"), F.concat_ws("/", "source", "lang")).join(labels, "doc_id").filter(L.held_out())
    assert found.filter("(quality = 1) = keep").count() / found.count() > 0.95


def test_posteriors_equal_plain_sums(spark):
    rows = [(1, "a", "p"), (2, "a", "p"), (3, "a", "q"), (4, "b", "q"), (5, None, None)]
    docs = spark.createDataFrame([(i, "good words here " * i, h, p) for i, h, p in rows], "doc_id long, text string, source string, path string")
    theta = np.zeros(len(Q.shape(b"")))
    theta[1] = 1.0
    model = Q.Evidence(theta, 0.0)
    got = {r.doc_id: r for r in Q.assess(docs, model, F.col("source"), F.concat_ws("/", "source", "path")).collect()}
    p = {i: 1 / (1 + np.exp(-got[i].evidence)) for i in got}
    mean = sum(p.values()) / 5
    assert got[4].host_share == pytest.approx(mean) and got[5].host_share == pytest.approx(mean)  # nothing but itself: the prior
    shrunk = [(got[1].host_share - mean), (p[2] + p[3]) / 2 - mean]
    assert abs(shrunk[0]) <= abs(shrunk[1]) and shrunk[0] * shrunk[1] >= 0


def test_posteriors_equal_brute_force(spark):
    """All columns of every row against plain loops, with a third of the rows on one path."""
    rng = np.random.default_rng(4)
    rows = [(i, "good plain words here " * int(rng.integers(0, 9)) + "!!! $$$ " * int(rng.integers(0, 4)), "big" if i % 3 == 0 else f"h{i % 7}", "p" if i % 3 == 0 else f"p{i % 4}") for i in range(210)]
    model = Q.fit([b"good plain words here and there"] * 20 + [b"!!! $$$"] * 10, [1] * 20 + [0] * 10, 0.6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    got = {r.doc_id: r for r in Q.assess(docs, model, F.col("source"), F.concat_ws("/", "source", "path")).collect()}
    p = {i: 1 / (1 + np.exp(-model.logits([t.encode()])[0])) for i, t, _, _ in rows}
    mean = sum(p.values()) / len(p)

    def groups(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(p[r[0]])
        return out

    def strength(found):
        some = [x for x in found if len(x) > 1]
        n = sum(map(len, some))
        within = max(sum(sum(v * v for v in x) - sum(x) ** 2 / len(x) for x in some) / n, 1e-9)
        between = max(sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in some) / n - within * len(some) / n, 1e-9)
        return min(500.0, max(2.0, within / between))

    hosts, paths = groups(lambda r: r[2]), groups(lambda r: (r[2], r[3]))
    k_host, k_path = strength(hosts.values()), strength(paths.values())
    logit = lambda x: np.log(min(1 - 1e-4, max(1e-4, x)) / (1 - min(1 - 1e-4, max(1e-4, x))))
    for i, _, host, path in rows:
        own, h, f = p[i], hosts[host], paths[host, path]
        host_share = (sum(h) - own + k_host * mean) / (len(h) - 1 + k_host)
        path_share = (sum(f) - own + k_path * host_share) / (len(f) - 1 + k_path)
        score = 1 / (1 + np.exp(-(np.log(own / (1 - own)) + 0.5 * (logit(path_share) - logit(mean)))))
        assert (got[i].host_share, got[i].path_share, got[i].score) == pytest.approx((host_share, path_share, score)) and got[i].keep == (score >= Q.KEEP)


def test_quality_odd_rows(odd, nothing, spark):
    model = Q.fit([b"plain words in a row"] * 5 + [b"!!!"] * 5, [1] * 5 + [0] * 5, 0.5)
    got = Q.assess(odd, model, F.col("source"), F.col("lang"))
    assert got.count() == odd.count() and got.filter("score is null or keep is null").count() == 0
    assert Q.assess(nothing, model, F.col("source"), F.col("lang")).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.assess(odd, Q.train(odd, none), F.col("source"), F.col("lang")).count() == odd.count()
