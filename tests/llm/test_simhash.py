import random
import re

import numpy as np
import xxhash

from quernel.llm import simhash as S
from quernel.llm.base import components

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def flood(ids, prints, distance=4):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_equals_brute_force(table):
    rng = random.Random(2)
    word = lambda: rng.choice("the of and an in on to is at by le la un der die das".split()) + rng.choice(["", "", "x", "É", "ß"])
    texts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    long = " ".join(word() for _ in range(400)).split()
    texts += [" ".join(long[:i] + ["changed"] + long[i + 1 :]) for i in range(0, 400, 10)] + [None, "", " \t\n", "one", "One two", "ONE two"] + [texts[0]] * 5
    rows = list(enumerate(texts))
    prints = {i: plain_fingerprint(t) for i, t in rows}
    expected = flood([i for i, _ in rows], prints)
    got = S.simhash_components(table(rows, SCHEMA, ["fp", "component"]))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == {i: (f"{prints[i]:016x}", expected[i]) for i, _ in rows}
    kept = S.simhash_dedup(table(rows + rows[:3], SCHEMA, ["_keep"]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_chunks_of_one_bucket(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (80, 2))})
    frame = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    expected = flood(prints, {p: p for p in prints})
    for coarse in (100, 2):  # by one segment, and large buckets by two
        got = {r.fp: r.component for r in S.hamming_components(frame, 4, chunk=8, coarse=coarse).collect()}
        assert got == {p: prints.index(expected[p]) for p in prints}


def test_empty_and_null_ids(table):
    assert S.simhash_components(table([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e"), (4, "a b c d e"), (None, "quite another text that is here for no reason at all")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in S.simhash_components(table(rows, SCHEMA)).collect())
    assert got == [(0, 0), (0, 4), (4, 4)]
    assert S.simhash_dedup(table(rows, SCHEMA)).count() == 3


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(30)}


def test_components_of_large_ids(spark):
    edges = [(2**62 + i, 2**62 + i + 1) for i in range(12)] + [(-(2**63), -(2**62)), (-(2**62), -5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2**62 + i: 2**62 for i in range(13)} | dict.fromkeys((-(2**63), -(2**62), -5), -(2**63))


def test_null_ids_bridge(spark):
    rows = [(0, 5), (0b1111, None), (0b11111111, 3), (-1, None)]
    got = {r.fp: r.component for r in S.hamming_components(spark.createDataFrame(rows, "fp long, rep long"), 4).collect()}
    assert got == {0: 3, 0b1111: 3, 0b11111111: 3, -1: None}
