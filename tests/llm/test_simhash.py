import itertools
import random
import re

import numpy as np
import xxhash

from spindrift.llm import simhash as S


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_golay_decodes_up_to_three_errors():
    golay, rng = S.Golay(), np.random.default_rng(1)
    messages = rng.integers(0, 4096, 500)
    word = (messages << 11) | S._remainder(messages << 11)
    for errors in range(4):
        noise = np.array([sum(1 << int(b) for b in rng.choice(23, errors, replace=False)) for _ in messages], dtype=np.int64)
        assert (golay.decode(word ^ noise) == messages).all()


def test_fingerprints(spark):
    texts = ["A b c d e", "a B C D e", "one two", "x", "", None, "é É ß x y", "a  b\tc\x0b d"]
    got = {r.doc_id: r.fp for r in S.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {k: v & (2**64 - 1) for k, v in got.items()} == {i: fingerprint(t) for i, t in enumerate(texts)}


def near(rng, n, flips):
    """Clusters of fingerprints, chains, and scattered ones."""
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.randrange(0, 6)):
            for _ in range(rng.randrange(0, flips + 1)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


def check(spark, fps, bucket):
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    edges = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket)
    found = {r.hi: r.lo for r in S.components(edges).collect()}
    want = classes(fps)
    label = [found.get(x, x) for x in signed]
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))
    assert all((a ^ b if a >= 0 else (a ^ b) & (2**64 - 1)) is not None for a, b in found.items())


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    check(spark, near(rng, 120, 3), S.BUCKET)
    check(spark, near(rng, 120, 3), 0)  # every bucket by wider keys, then by midpoints


def test_wide_keys_find_every_link(spark, monkeypatch):
    """Buckets that are too large for the first keys alone: no member reaches the midpoints."""
    rng = random.Random(9)
    fps = near(rng, 150, 3)
    meet, calls = S._met, []
    monkeypatch.setattr(S, "_met", lambda keys, bucket: calls.append(1) or meet(keys, 0 if len(calls) % 2 else 10**6))
    monkeypatch.setattr(S, "_midpoints", lambda batches: iter(()))
    check(spark, fps, S.BUCKET)


def test_hot_keys_meet_in_place(spark):
    docs = [(i, "the very same text in many rows") for i in range(300)] + [(1000 + i, f"text number {i} {i * i} alone {i * 7}") for i in range(50)]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == 350 and {got[i] for i in range(300)} == {0}


def test_one_large_cluster(spark):
    rng, centre = random.Random(4), random.Random(5).getrandbits(64)
    fps = sorted({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)})
    check(spark, fps, S.BUCKET)


def test_long_chain(spark):
    x, chain = 0, []
    for b in range(0, 60):
        x ^= 3 << b
        chain.append(x)
    check(spark, sorted(set(chain)), S.BUCKET)


def test_documents(spark, odd, nothing):
    got = S.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.component_id, set()).add(r.doc_id)
    assert by[1] >= {1, 2, 6}  # no words: fingerprint zero; the null id joins without being the smallest
    assert {4, 5} <= next(v for v in by.values() if 5 in v)
    assert S.near_duplicates(nothing).count() == 0
