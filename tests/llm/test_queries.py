"""The registered queries over the smallest tables: against SQL where there is some, else against plain Python."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest

from quernel.llm import queries as Q
from quernel.llm import secrets as S

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


def held(doc_id, r):
    return zlib.crc32(str(doc_id).encode()) % 5 == r


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = Q.queries()[name](spark, DIR)
    rel = con.sql(Q.oracle_sql()[name])
    cols = sorted(got.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def test_op2(spark, docs):
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in docs.items()}
    c = Counter(w for i, ws in words.items() if not held(i, 1) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in Q.op2_lm_scoring(spark, DIR).collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 1), len(words[i]), sum(w in c for w in words[i]), n)
        assert math.isclose(r.base_score, sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words[i]), rel_tol=1e-9) and r.score < 0
    assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)


def test_op4(spark, docs):
    from tests.llm.test_simhash import flood, plain_fingerprint

    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    expected = flood(sorted(docs), prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op4_simhash(spark, DIR).collect()} == {i: (f"{prints[i]:016x}", expected[i]) for i in docs}


@pytest.mark.skipif(not os.path.exists(Q.PIECE_MODEL), reason="no vocabulary")
def test_op5(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_MODEL)
    for r in Q.op5_sentencepiece(spark, DIR).collect():
        assert list(r.ids) == library.encode(docs[r.doc_id] or "") and r.n_ids == len(r.ids) and r.round_trip in (True, None)


def test_op6(spark, con, docs):
    lang = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = {r.doc_id: r for r in Q.op6_language_id(spark, DIR).collect()}
    assert set(rows) == set(docs) and all(r.held_out == held(i, 0) and 0 <= r.score <= 1 for i, r in rows.items())
    assert all((r.lang_pred == "und") == (not any(x.isalpha() for x in docs[i] or "")) for i, r in rows.items())
    tested = [i for i, r in rows.items() if r.held_out and lang[i] is not None and r.lang_pred != "und"]
    assert sum(rows[i].lang_pred == lang[i] for i in tested) >= 0.95 * len(tested)


def test_op7(spark, docs):
    for r in Q.op7_secrets(spark, DIR).collect():
        text = docs[r.doc_id] or ""
        base = [("assign", m.start(), m.end()) for m in S.ASSIGN.finditer(text) if len(m[2]) >= 8]
        base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        base.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        n = Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_op10(spark, docs):
    rows = Q.op10_sharding(spark, DIR).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in docs.items()}
    assert {r.doc_id: r["size"] for r in rows} == size and {r.law for r in rows} == {"bytes"}
    assert all(r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) and 0 <= r.shard < 8 and r.grown_shard is None for r in rows)
    place = {}
    for r in rows:
        assert place.setdefault(docs[r.doc_id] or "", r.shard) == r.shard
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
