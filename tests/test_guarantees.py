"""What holds across crashes, schema changes, lifetimes and watches."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from quernel.engine import Database
from quernel.functions import keys
from quernel.kv import KeyValues
from quernel.plans.evolve import diff
from quernel.schema import INGESTED, Field, FieldType, ForeignKey, Index, SchemaError, Table, Ttl
from quernel.sources.snapshots import Folder, Store

T = FieldType
ITEMS = Table("items", (Field("name", T.text), Field("n", T.integer)))


def test_a_commit_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    db = Database.open(spark, str(tmp_path), schemas=[ITEMS])
    db.batch_insert("items", [{"name": "a", "n": 1}])

    def crash(*_):
        raise OSError("gone before the manifest was there")

    with monkeypatch.context() as m:
        m.setattr(Folder, "create_text", crash)
        with pytest.raises(OSError):
            db.batch_insert("items", [{"name": "b", "n": 2}])
    again = Database.open(spark, str(tmp_path))
    assert [r.name for r in again.query("items").df().collect()] == ["a"]
    for i in range(5):
        assert again.insert("items", {"name": f"c{i}"}).is_success
    folder = Folder(spark, f"{tmp_path}/db")
    assert len([n for n in folder.names() if n.startswith("manifest-") and n.endswith(".json")]) == 3
    assert Database.open(spark, str(tmp_path)).query("items").count() == 6
    late = Store(folder)
    with pytest.raises(FileExistsError):  # another writer was faster
        late.commit(late.load() | {"version": again.manifest["version"] - 1})
    assert Database.open(spark, str(tmp_path)).query("items").count() == 6


def test_schema_changes_are_checked_against_the_rows(spark):
    parent = Table("parent", (Field("x", T.integer),))
    db = Database.memory(spark, [ITEMS, parent])
    db.batch_insert("items", [{"name": "a", "n": 1}, {"name": "a", "n": 2}, {"name": None, "n": 7}])
    db.batch_insert("parent", [{"id": 1}, {"id": 2}])
    change = lambda: db.update_schema("items")
    for refused in (
        change().add_index(["name"], unique=True), change().add_field("must", T.integer, nullable=False), change().modify_field("name", T.text, nullable=False), change().modify_field("n", T.integer, max_value=5),
        change().add_foreign_key(ForeignKey(("n",), "parent", ("id",))), change().add_foreign_key(ForeignKey(("n",), "nowhere", ("id",))), change().modify_field("name", T.integer),
    ):
        with pytest.raises(SchemaError):
            refused.run()
        assert list(db.migrations.values())[-1]["state"] == "failed" and db.schema("items") == ITEMS
    assert db.delete("items").where("n", "=", 7).run().is_success
    for done in (change().add_index(["n"], unique=True), change().add_field("must", T.integer, nullable=False, default=3), change().modify_field("name", T.text, nullable=False), change().add_foreign_key(ForeignKey(("n",), "parent", ("id",)))):
        done.run()
    assert db.insert("items", {"name": "b", "n": 2}).is_failed and {r.must for r in db.query("items").df().collect()} == {3}


def test_renames_by_likeness():
    old = Table("t", (Field("customer_name", T.text), Field("amount", T.double), Field("note", T.text)))
    new = Table("t", (Field("customer_full_name", T.text), Field("amount", T.double), Field("zip", T.text)))
    assert diff(old, new) == [("rename_field", "customer_name", "customer_full_name"), ("add_field", "zip", Field("zip", T.text)), ("remove_field", "note", None)]
    both = Table("t", (Field("customer_name1", T.text), Field("customer_name2", T.text), Field("amount", T.double), Field("note", T.text)))
    assert not [op for op in diff(old, both) if op[0] == "rename_field"]  # two would do
    other = Table("t", (Field("customer_names", T.integer), Field("amount", T.double), Field("note", T.text)))
    assert not [op for op in diff(old, other) if op[0] == "rename_field"]


def test_lifetime_from_ingest(spark):
    t = Table("logs", (Field("x", T.integer),), ttl=Ttl(60_000))
    db = Database.memory(spark, [t])
    assert db.batch_insert("logs", [{"x": 1}, {"x": 2}]).is_success
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    assert db.query("logs").df().columns == ["id", "x"] and INGESTED in db.frame("logs").columns
    stamp = db.frame("logs").first()[INGESTED]
    assert db.update("logs", {"x": 5}).where("id", "=", 1).run().is_success and db.upsert("logs", {"id": 2, "x": 6}).is_success
    assert {r[INGESTED] for r in db.frame("logs").collect()} == {stamp}  # an update does not renew a row
    assert db.cleanup_ttl("logs", now).success_keys == []
    assert sorted(db.cleanup_ttl("logs", stamp + dt.timedelta(minutes=1)).success_keys) == ["1", "2"] and db.query("logs").count() == 0
    assert db.declare([t]) == []
    late = Database.memory(spark, [ITEMS])
    late.insert("items", {"name": "a"})
    late.update_schema("items").set_ttl_config(Ttl(1000)).run()
    assert late.cleanup_ttl("items", now).success_keys == [] and late.cleanup_ttl("items", now + dt.timedelta(days=1)).success_keys == ["1"]


def test_only_changes_of_matching_rows_wake_a_watch(spark, monkeypatch):
    from quernel.plans.query import QueryBuilder

    db = Database.memory(spark, [ITEMS])
    db.batch_insert("items", [{"name": "a", "n": 1}, {"name": "b", "n": 20}])
    runs = []
    page = QueryBuilder.page
    monkeypatch.setattr(QueryBuilder, "page", lambda self: runs.append(1) or page(self))
    seen = db.query("items").where("n", ">", 10).watch(timeout=1)
    assert [r.name for r in next(seen)] == ["b"]
    db.update("items", {"name": "c"}).where("n", "=", 1).run()  # not a row of the query
    assert next(seen, None) is None and len(runs) == 1
    for change, expected in (
        (lambda: db.update("items", {"n": 30}).where("id", "=", 1).run(), ["c", "b"]), (lambda: db.update("items", {"n": 0}).where("id", "=", 2).run(), ["c"]), (lambda: db.insert("items", {"name": "d", "n": 99}), ["c", "d"]),
        (lambda: db.delete("items").where("id", "=", 1).run(), ["d"]),
    ):
        seen = db.query("items").where("n", ">", 10).watch(timeout=20)
        next(seen)
        change()
        assert [r.name for r in next(seen)] == expected
        seen.close()


def test_a_watched_value_wakes_when_it_expires(spark):
    db = Database.memory(spark)
    kv = KeyValues(db)
    kv.set("a", 1, ttl=dt.timedelta(seconds=8))
    seen = kv.watch("a", timeout=60)
    assert next(seen) == 1
    got = []
    t = threading.Thread(target=lambda: got.append(next(seen)))
    t.start()
    t.join(50)
    assert got == [None]


def test_full_order_and_batches(spark):
    db = Database.memory(spark, [ITEMS])
    db._set({"items": spark.range(1, 501).select("id", F.concat(F.lit("n"), F.col("id") % 7).alias("name"), F.when(F.col("id") % 5 > 0, F.col("id") * 37 % 101).alias("n")).repartition(4)})
    rows = db.query("items").order_by_asc("name").order_by_desc("n").df().collect()
    expected = sorted(rows, key=lambda r: (r.name, r.n is None, -(r.n or 0), r.id))
    assert len(rows) == 500 and rows == expected
    sizes, ids = [], []
    assert db.query_each_batch(db.query("items"), lambda part: sizes.append(len(part)) or ids.extend(r.id for r in part), 120) == 500
    assert sizes == [120] * 4 + [20] and ids == list(range(1, 501))
    assert db.query_each_batch(db.query("items").order_by_desc("id"), lambda part: False, 120) == 120


def test_sequential_keys_of_text_and_hot_values(spark):
    frame = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") * 7 % 400)).alias("name"))
    got = keys.sequential(frame, ["name", "id"], "k", 10, 2, parts=4).collect()
    assert [(r.name, r.id) for r in sorted(got, key=lambda r: r.k)] == sorted((r.name, r.id) for r in got) and sorted(r.k for r in got) == list(range(10, 810, 2))


def test_unique_index_over_several_fields(spark):
    db = Database.memory(spark, [ITEMS.with_(indexes=(Index(("name", "n"), unique=True),))])
    assert db.batch_insert("items", [{"name": "a", "n": 1}, {"name": "a", "n": 2}, {"name": "a"}, {"name": "a"}]).is_success
    assert db.batch_update("items", [{"id": 2, "n": 1}]).is_failed and db.batch_update("items", [{"id": 3, "n": 1}, {"id": 4, "n": 3}]).is_partial
    assert db.update("items", {"n": 9}).where("name", "=", "a").run().is_failed


def test_approximate_search(spark):
    import numpy as np

    from quernel.operators.vector_index import recall

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(3000, None, 1), (3001, [1.0, 2.0], 1), (3002, [0.0] * 32, 1)]
    db = Database.memory(spark, [Table("v", (Field("e", T.vector, width=32), Field("n", T.integer)))])
    db._set({"v": spark.createDataFrame(rows, "id long, e array<double>, n long").repartition(3)})
    for metric in ("cosine", "l2", "ip"):
        scores = []
        for q in x[:8] + rng.normal(size=(8, 32)) * 0.3:
            exact = db.vector_search("v", "e", q.tolist(), 10, metric)
            near = db.vector_search("v", "e", q.tolist(), 10, metric, ef_search=120)
            scores.append(recall(near, exact, "id"))
            assert near.columns == exact.columns
        assert sum(scores) / len(scores) >= 0.9
    index = db.vector_index("v", "e")
    assert index.codes.count() == 3001 and len(index.codes.first().code) == 16
    assert db.delete("v").where("id", "=", 5).run().is_success and db.batch_update("v", [{"id": 7, "e": x[5].tolist()}, {"id": 8, "n": 2}]).is_success
    near = db.vector_search("v", "e", x[5].tolist(), 1, "l2", ef_search=50).collect()
    assert [(r.id, round(r.distance, 6)) for r in near] == [(7, 0.0)] and db.vector_index("v", "e") is index and index.codes.count() == 3000
    assert db.vector_search("v", "e", x[9].tolist(), 3, "l2", threshold=0.5, ef_search=50).count() == 1


def test_index_search_equals_search_over_all_rows(spark):
    """Copies of rows whose codes are nearer crowd the candidates; the nearest rows are found all the same."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32)).astype("float32")
    rows = [(i + 10_000 * g, v.tolist()) for g in range(12) for i, v in enumerate(x)] + [(-1, None), (-2, [0.0] * 32), (-3, [float("nan")] * 32)]
    db = Database.memory(spark, [Table("v", (Field("e", T.vector, width=32),))])
    db._set({"v": spark.createDataFrame(rows, "id long, e array<float>").repartition(3)})
    for metric in ("cosine", "l2", "ip"):
        for q in (x[0], rng.normal(size=32) * 0.3):
            for k, threshold in ((1, None), (30, 0.4)):
                found = [db.vector_search("v", "e", q.tolist(), k, metric, threshold, ef_search=ef).collect() for ef in (None, 40)]
                assert found[0] == found[1], (metric, k, threshold)


def test_parallel_vectors_tie_as_in_sql(spark):
    """Single-precision vectors, whose products are exact in double precision."""
    import duckdb
    import numpy as np

    x = np.random.default_rng(5).normal(size=(4, 64)).astype("float32").astype(float)
    rows = [(i * 100 + j, (v * k).astype("float32").tolist()) for i, v in enumerate(x) for j, k in enumerate((1.0, 3.0, 0.1, 1 / 3, 7.7, 1e-5, 123.4, 0.9))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, e DOUBLE[])")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    db = Database.memory(spark, [Table("v", (Field("e", T.vector, width=64),))])
    db._set({"v": spark.createDataFrame(rows, "id long, e array<double>")})
    for q in x.tolist():
        want = con.execute("SELECT id FROM t ORDER BY 1 - list_cosine_similarity(e, ?::DOUBLE[]), id LIMIT 12", [q]).fetchall()
        for ef in (None, 20):
            assert [(r.id,) for r in db.vector_search("v", "e", q, 12, "cosine", ef_search=ef).collect()] == want
