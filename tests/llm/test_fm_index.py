import random
import re

import numpy as np

from spindrift.llm import fm_index as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window):
    phrases = {}
    for name, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        if words and name is not None:
            for k in range(max(1, len(words) - window + 1)):
                phrases.setdefault(tuple(words[k : k + window]), set()).add(str(name))
    out = []
    for name, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        hit, own = [0] * len(words), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(words) - n + 1):
                if (some := phrases.get(tuple(words[k : k + n]))) is not None:
                    own |= some
                    hit[k : k + n] = [1] * n
        out.append((name, len(words), sum(hit), sorted(own)))
    return out


def found(df):
    out = []
    for r in df.collect():
        lo, hi = M.merged_hits([h.asDict() for h in r.hits])
        out.append((r.doc_id, r.n_words, int((hi - lo).sum()), r["items"]))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "A", "b", "ça", "9", "x-y", "und"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.randrange(0, 9))) for i in range(25)] + [(30, None), (None, "the of"), (31, "..."), (7, sentence(6))]
    docs = [(i, ", ".join([sentence(rng.randrange(0, 30)), rng.choice(items)[1] or "", "other words"])) for i in range(80)] + [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = sorted(brute(docs, items, 5), key=str)
    assert found(M.find_contamination(table, bench, 5)) == want
    assert found(M.find_contamination(table, bench, 5, block_chars=40)) == want  # several blocks


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, 4000)
    phrases = M.Phrases([("a", [b"p", b"q"]), ("b", [b"p", b"r", b"p"]), ("c", [b"q"] * 7)], 7)
    which, at = M.occurrences(codes, phrases)
    got = sorted(zip(which.tolist(), at.tolist()))
    want = []
    for k, (row, n) in enumerate(zip(phrases.codes, phrases.lengths)):
        want += [(k, s) for s in range(len(codes) - n + 1) if (codes[s : s + n] == row[:n]).all()]
    assert got == sorted(want)


def test_removal_and_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "jumps over the lazy dog and then some more words follow it here")], "item_id long, text string")
    found = M.find_contamination(odd, bench)
    cleaned = M.remove_contamination(found)
    assert cleaned.columns == [c for c in odd.columns if c not in ("hits", "items", "n_words")] and cleaned.count() == odd.count()
    assert all("lazy dog" not in (r.text or "") for r in cleaned.collect())
    assert sorted(map(str, M.find_contamination(odd, bench, remove=True).collect())) == sorted(map(str, cleaned.collect()))
    two = bench.union(spark.createDataFrame([(2, "no id at all plain words")], "item_id long, text string"))
    assert M.find_contamination(odd, two, block_chars=10, remove=True).filter("text = 'no id at all, plain words'").count() == 0
    assert cleaned.filter("doc_id = 7").first().text == "12345 678 !!"
    empty = bench.limit(0)
    assert found.filter("doc_id = 1").first().n_words == 0 and M.find_contamination(odd, empty).count() == odd.count()
    assert M.find_contamination(nothing, bench).count() == 0


def test_without_words():
    assert M.without_words("Äpfel, a b c. End".encode(), np.array([1]), np.array([3])) == "Äpfel,  c. End".encode()
