import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernel.llm import lm_scoring as M

DOCS = "doc_id long, text string"
SMALL = M.Shape(words=12, groups=4, classes=4, width=8, listed=10)


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def chain(rng, n):
    """A text whose words depend on the word before."""
    pair = {"a": "bcd", "b": "ef", "c": "gh", "d": "a", "e": "a", "f": "a", "g": "b", "h": "c"}
    w = ["a"]
    while len(w) < n:
        w.append(rng.choice(pair[w[-1]]))
    return " ".join(x * 3 for x in w)


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def held():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1


def test_counts_and_base(table):
    rng = random.Random(0)
    rows = [(i, chain(rng, 200)) for i in range(60)] + [(100, None), (101, ""), (102, "AAA never seen \x1c\x85"), (1, chain(rng, 3)), (7, "dup"), (7, "dup")]
    docs = table(rows, DOCS, ["score", "own"])
    out = M.score(docs, held(), shape=SMALL).collect()
    c = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    total, types = sum(c.values()), len(c)
    expected = sorted((i, len(tokens(t)), sum(w in c for w in tokens(t)), round(sum(np.log10((c.get(w, 0) + 0.5) / (total + 0.5 * (types + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == expected
    assert {r.train_tokens for r in out} == {total}
    assert all(np.isfinite(r.score) and r.score < 0 and r.held_out == is_held(r.doc_id) for r in out)
    assert M.score(table([], DOCS), F.lit(False), shape=SMALL).count() == 0
    assert M.score(docs, F.lit(True), shape=SMALL).count() == len(rows)


def test_scores_do_not_depend_on_splits_and_beat_the_base(table):
    rng = random.Random(3)
    rows = [(i, chain(rng, rng.randint(100, 300))) for i in range(150)]
    docs = table(rows, DOCS)
    shape = M.Shape(words=20, groups=4, classes=4, width=8, listed=100)
    found = [{r.doc_id: (r.score, r.base_score) for r in M.score(docs.repartition(n), held(), shape=shape, cell=4000).collect()} for n in (1, 8, 64)]
    for other in found[1:]:
        assert all(math.isclose(found[0][i][0], other[i][0], rel_tol=1e-5) for i, _ in rows)
    own = [i for i, _ in rows if is_held(i)]
    assert sum(found[0][i][0] for i in own) > sum(found[0][i][1] for i in own)  # logarithms, so above is better


def test_rounds_and_shards():
    assert M.cells_of(0) == (1, 1) and M.cells_of(M.CELL) == (1, 1) and M.cells_of(9 * M.CELL) == (1, 9)
    rounds, shards = M.cells_of(1000 * M.CELL)
    assert rounds == M.MOST_ROUNDS and rounds * shards >= 1000


def small_model(rng):
    shape = M.Shape(words=10, groups=3, classes=4, width=5, context=2)
    words = [(b"w%d" % i, 20 - i) for i in range(14)]
    mass, kinds = np.zeros(3), np.zeros(3)
    for w, n in words:
        mass[M.group_of(w, 3)] += n
        kinds[M.group_of(w, 3)] += 1
    v = M.Vocabulary(shape, words, sum(n for _, n in words), len(words), mass, kinds)
    m = M.Model(v)
    for _ in range(4):
        m.train(M.joined_stream([rng.integers(0, 13, 250), rng.integers(0, 13, 3)], 2, m.pad), rng)
    return v, m


def plain_score(v, m, text):
    """The log10-probability of a text by the definition, in plain Python; a token outside the list was never seen."""
    p, sig = {k: x.astype(float).tolist() for k, x in m.p.items()}, 0.0
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    before = [m.pad] * m.context
    for t in tokens(text):
        code = int(v.code(pa.array([t], pa.binary()))[0])
        output = int(v.output[code]) if code >= 0 else v.shape.words - 1 - code
        place = int(v.place[output])
        h = [sum(p["P"][i][d] * p["R"][before[-1 - i]][d] for i in range(m.context)) for d in range(len(p["R"][0]))]
        k = place // v.size
        classes = [dot(h, x) + a for x, a in zip(p["K"], p["a"], strict=True)]
        words = [dot(h, p["Q"][j]) + p["b"][j] for j in range(k * v.size, (k + 1) * v.size)]
        sig += classes[k] - math.log(sum(map(math.exp, classes))) + words[place - k * v.size] - math.log(sum(map(math.exp, words)))
        if output >= v.shape.words:
            count = int(v.counts[code]) if code >= 0 else 0
            sig += math.log(count + 0.5) - math.log(10) * float(v.group_room[output - v.shape.words])
        before.append(place)
    return sig / math.log(10)


def test_score_of_a_text_equals_plain_python():
    rng = np.random.default_rng(4)
    v, m = small_model(rng)
    for text in ["", "w0 w1 W2 w0", "w3 w13 w12 w0 w0 w11", " ".join(f"w{i % 14}" for i in range(60))]:
        t = M.Tokens.of(pa.array([text]))
        codes = v.code(t.words)
        places, grouped, room, count = (x[t.at] for x in v.parts(codes))
        count = np.where(codes[t.at] < 0, np.log10(0.5), count)  # never seen: the join with the counts finds nothing
        stream = M.joined_stream([places], m.context, m.pad)
        logs = np.concatenate([m.log_probs(w, step=7) for w in M.windows(stream, m.context, 16)]) / M.LN10 + np.where(grouped, count - room, 0)
        assert math.isclose(logs.sum(), plain_score(v, m, text), rel_tol=1e-4)


def test_model_is_normalised():
    v, m = small_model(np.random.default_rng(1))
    stream = M.joined_stream([np.arange(5), np.arange(3)], 2, m.pad)
    assert stream.tolist() == [m.pad, m.pad, 0, 1, 2, 3, 4, m.pad, m.pad, 0, 1, 2]
    every = np.arange(v.shape.classes * v.size)
    for context in ([m.pad, m.pad], [m.pad, 3], [5, 7]):
        # each word behind the context; the context's own words are scored too, at the front
        one = np.array([m.pad, m.pad, *[x for x in context if x != m.pad], 0])
        logs = [m.log_probs(np.append(one[:-1], w))[-1] for w in every]
        assert np.isclose(np.exp(logs).sum(), 1, atol=1e-4)


def test_far_scores_do_not_vanish():
    h, vectors = np.array([[1.0], [-1.0]], np.float32) * 60, np.array([[1.0], [2.0]], np.float32)
    got = M._log_share(h, vectors, np.zeros(2, np.float32), np.array([0, 0]))
    assert np.allclose(got, [-60, 0], atol=1e-4)


@pytest.mark.parametrize("text", [None, "", " ", "a  b", " A\tb\n", "é É ß\x1c", "x" * 5000])
def test_tokens(text):
    t = M.Tokens.of(pa.array(["first one", text, "A"], pa.string()))
    words = t.words.to_pylist()
    assert [words[i] for i in t.at] == tokens("first one") + tokens(text) + tokens("A")
    assert t.sizes.tolist() == [3, len(tokens(text)), 2] and t.starts.tolist() == [0, 3, 3 + len(tokens(text))]
