import datetime as dt

import pytest
from pyspark.sql import functions as F

from quernel.engine import Database
from quernel.functions import expr as X
from quernel.kv import KeyValues
from quernel.operators.write import Status
from quernel.plans.aggregate import Agg
from quernel.plans.condition import Condition
from quernel.plans.cursor import CursorError
from quernel.schema import Action, Field, FieldType, ForeignKey, Index, SchemaError, Table, Ttl

T = FieldType
USERS = Table("users", (Field("username", T.text, nullable=False, unique=True), Field("email", T.text), Field("age", T.integer, default=18), Field("fans", T.integer, default=10), Field("seen", T.datetime)), indexes=(Index(("email",), unique=True),))
POSTS = Table("posts", (Field("title", T.text, nullable=False, max_length=12), Field("user_id", T.integer, nullable=False)), foreign_keys=(ForeignKey(("user_id",), "users", ("id",), on_delete=Action.cascade, on_update=Action.cascade),))
COMMENTS = Table("comments", (Field("post_id", T.integer), Field("user_id", T.integer)), foreign_keys=(ForeignKey(("post_id",), "posts", ("id",), on_delete=Action.cascade), ForeignKey(("user_id",), "users", ("id",), on_delete=Action.restrict)))


@pytest.fixture
def db(spark):
    db = Database.memory(spark, [COMMENTS, POSTS, USERS])
    people = [{"username": f"user_{i}", "email": f"u{i}@x", "age": a, "fans": 100 * k} for k, (i, a) in enumerate(zip((1, 2, 10, 20, 3), (10, 20, 30, 40, 50), strict=True), 1)]
    assert db.batch_insert("users", people).is_success
    return db


def names(b):
    return {r.username for r in b.df().collect()}


def test_literals_like_and_ranges(db):
    assert names(db.query("users").where("age", "=", "20")) == {"user_2"}
    assert len(names(db.query("users").where("age", ">", "40"))) == 1
    assert names(db.query("users").where_like("username", "user_1%")) == {"user_1", "user_10"}
    assert len(names(db.query("users").where_contains("username", "user"))) == 5
    assert len(names(db.query("users").where("fans", ">=", 400))) == 2
    assert [r.id for r in db.query("users").page().rows] == [1, 2, 3, 4, 5]


def test_insert_rules(db):
    r = db.batch_insert("users", [{"username": "new", "age": "33"}, {"username": "user_1"}, {"username": "new"}, {"age": 1}, {"username": "odd", "age": "x"}])
    assert r.is_partial and len(r.success_keys) == 1 and len(r.failed_keys) == 4
    row = db.query("users").where("username", "=", "new").first()
    assert (row.id, row.age, row.fans) == (6, 33, 10)
    assert db.batch_insert("users", [{"username": "ok"}, {"username": "user_1"}], allow_partial_errors=False).is_failed
    assert db.query("users").count() == 6
    with pytest.raises(SchemaError):
        db.insert("users", {"username": "z", "nope": 1})
    assert db.insert("posts", {"title": "a title that is long", "user_id": 1}).is_success
    assert db.query("posts").first().title == "a title that"
    assert db.insert("posts", {"title": "t", "user_id": 99}).is_failed


def test_upsert_by_any_unique_key(db):
    assert db.batch_upsert("users", [{"username": "user_2", "age": 21}, {"username": "fresh", "age": 5}]).is_success
    rows = {r.username: r for r in db.query("users").df().collect()}
    assert rows["user_2"].age == 21 and rows["user_2"].fans == 200 and rows["user_2"].id == 2
    assert rows["fresh"].fans == 10 and rows["fresh"].id == 6
    r = db.batch_upsert("users", [{"username": "user_1", "email": "u2@x"}])
    assert r.is_failed
    db.batch_upsert("users", [{"username": "user_3", "age": 1}, {"username": "user_3", "age": 2}])
    assert db.query("users").where("username", "=", "user_3").first().age == 2
    db.batch_upsert("users", [{"username": "user_3", "fans": X.if_else(X.is_update(), X.field("fans") + 1, 1)}])
    assert db.query("users").where("username", "=", "user_3").first().fans == 501


def test_updates(db):
    assert db.update("users").where("username", "=", "nobody").set_field("age", 1).run().status == Status.notFound
    with pytest.raises(ValueError):
        db.update("users", {"age": 1}).run()
    with pytest.raises(SchemaError):
        db.update("users", {"id": 9}).where("id", "=", 1).run()
    assert db.update("users").where("id", "<=", 2).increment("age", 5).divide("fans", 0).run().is_success
    assert [(r.age, r.fans) for r in db.query("users").where("id", "<=", 2).order_by_asc("id").df().collect()] == [(15, 0), (25, 0)]
    assert db.update("users", {"email": "same"}).where("id", "<=", 2).run().is_failed
    assert db.batch_update("users", [{"id": 1, "age": 77}, {"id": 99, "age": 1}]).is_partial
    assert db.query("users").where("id", "=", 1).first().age == 77
    assert db.delete("users").where("id", "=", 1234).run().is_success
    assert db.delete("users").order_by_desc("age").limit(1).run().is_success and db.query("users").count() == 4


def test_rows_change_only_what_they_supply(db):
    before = {r.id: r for r in db.query("users").df().collect()}
    assert db.batch_update("users", [{"id": 1, "age": 50}, {"id": 2, "fans": 60}, {"id": 3, "age": None}, {"id": 1, "fans": 7}]).is_success
    after = {r.id: r for r in db.query("users").df().collect()}
    assert (after[1].age, after[1].fans) == (50, 7) and (after[2].age, after[2].fans) == (before[2].age, 60)
    assert (after[1].email, after[2].username) == (before[1].email, before[2].username) and after[3].age == 18 and after[4] == before[4]
    assert db.batch_upsert("users", [{"id": 1, "age": 51}, {"id": 2, "fans": 61}, {"username": "fresh", "email": "f@x"}]).is_success
    after = {r.username: r for r in db.query("users").df().collect()}
    assert (after["user_1"].age, after["user_1"].fans, after["user_2"].age, after["user_2"].fans) == (51, 7, 20, 61)
    assert (after["fresh"].age, after["fresh"].fans) == (18, 10)


def test_expressions_belong_to_their_rows(db):
    assert db.batch_upsert("users", [{"id": 1, "age": 7}, {"id": 2, "age": X.field("age") + 100}, {"id": 3, "age": X.field("age") * 2}, {"id": 4, "fans": 1}]).is_success
    assert [r.age for r in db.query("users").order_by_asc("id").df().collect()] == [7, 120, 60, 40, 50]
    assert db.batch_update("users", [{"id": 1, "age": X.field("age") - 1}, {"id": 2, "fans": X.field("fans") + X.field("age")}]).is_success
    rows = {r.id: r for r in db.query("users").df().collect()}
    assert (rows[1].age, rows[2].age, rows[2].fans) == (6, 120, 320)


def test_no_write_leaves_an_orphan(db):
    db.batch_insert("posts", [{"title": "p1", "user_id": 1}, {"title": "p2", "user_id": 2}])
    assert db.upsert("posts", {"title": "p", "user_id": 777}).is_failed
    assert db.upsert("posts", {"id": 1, "user_id": 777}).is_failed
    assert db.update("posts").where("id", "=", 1).set_field("user_id", 777).run().is_failed
    assert db.batch_update("posts", [{"id": 1, "user_id": 888}, {"id": 2, "user_id": 3}]).is_partial
    assert [(r.id, r.user_id) for r in db.query("posts").order_by_asc("id").df().collect()] == [(1, 1), (2, 3)]
    node = Table("node", (Field("next", T.integer),), foreign_keys=(ForeignKey(("next",), "node", ("id",)),))
    own = Database.memory(db.spark, [node])
    assert own.batch_insert("node", [{"id": 1, "next": 2}, {"id": 2, "next": 1}]).is_success
    assert own.upsert("node", {"id": 3, "next": 3}).is_success and own.upsert("node", {"id": 4, "next": 9}).is_failed


def test_no_write_shares_a_unique_value(db):
    assert db.upsert("users", {"id": 1, "email": "u2@x"}).is_failed
    r = db.batch_upsert("users", [{"username": "n1", "email": "new@x"}, {"username": "n2", "email": "new@x"}, {"username": "n3"}])
    assert r.is_partial and len(r.failed_keys) == 1
    assert db.query("users").where("email", "=", "new@x").count() == 1 and db.query("users").where("username", "=", "n3").count() == 1
    assert db.batch_update("users", [{"id": 1, "email": "u10@x"}, {"id": 2, "age": 1}]).is_partial
    rows = {r.id: r for r in db.query("users").df().collect()}
    assert rows[1].email == "u1@x" and rows[2].age == 1
    swap = [{"id": 1, "email": "u2@x"}, {"id": 2, "email": "u1@x"}]
    assert db.batch_update("users", swap).is_success and db.query("users").where("id", "=", 1).first().email == "u2@x"
    assert db.upsert("users", {"age": 3}).is_failed  # a new user needs a name


def test_updates_keep_all_rules(spark):
    t = Table("t", (Field("name", T.text, min_length=3, max_length=5), Field("n", T.integer, max_value=10), Field("v", T.vector, width=2)))
    db = Database.memory(spark, [t])
    assert db.insert("t", {"name": "abc", "n": 1, "v": [1.0, 2.0]}).is_success
    for bad in ({"name": "x"}, {"n": 11}, {"v": [1.0]}, {"n": "many"}, {"n": X.field("n") + 10}):
        assert db.update("t", bad).where("id", "=", 1).run().is_failed, bad
    assert db.batch_update("t", [{"id": 1, "n": X.field("n") + 10}]).is_failed and db.upsert("t", {"id": 1, "v": [1.0]}).is_failed
    assert db.update("t", {"name": "abcdefgh"}).where("id", "=", 1).run().is_success and db.query("t").first().name == "abcde"


def test_keys_of_frames_are_numbered_in_parts(spark):
    db = Database.memory(spark, [Table("t", (Field("x", T.integer), Field("u", T.text, unique=True)))])
    assert db.batch_insert("t", spark.range(1000).select(F.col("id").alias("x"))).is_success
    assert sorted(r.id for r in db.query("t").df().collect()) == list(range(1, 1001))


def test_cascades(db):
    db.batch_insert("posts", [{"title": "p1", "user_id": 1}, {"title": "p2", "user_id": 2}])
    db.batch_insert("comments", [{"post_id": 1, "user_id": 2}])
    assert db.delete("users").where("id", "=", 2).run().status == Status.foreignKeyViolation
    assert db.delete("users").where("id", "=", 1).run().is_success
    assert [r.title for r in db.query("posts").df().collect()] == ["p2"] and db.query("comments").count() == 0
    change = db.spark.createDataFrame([(2, 50)], "old long, new long")
    assert db.rekey("users", change).is_success
    assert db.query("posts").first().user_id == 50
    assert db.rekey("users", db.spark.createDataFrame([(50, 3)], "old long, new long")).is_failed


def test_cyclic_cascade(spark):
    node = Table("node", (Field("next", T.integer),), foreign_keys=(ForeignKey(("next",), "node", ("id",), on_delete=Action.cascade),))
    db = Database.memory(spark, [node])
    db._set({"node": spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, next long")})
    assert db.delete("node").where("id", "=", 1).run().is_success
    assert [r.id for r in db.query("node").df().collect()] == [4]


def test_paging_with_ties_and_nulls(spark):
    db = Database.memory(spark, [Table("t", (Field("g", T.integer),))])
    db._set({"t": spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(1, 24)], "id long, g long")})
    for desc in (False, True):
        b = db.query("t").limit(5)
        b = b.order_by_desc("g") if desc else b.order_by_asc("g")
        expected = [r.id for r in b.clone().limit(100).df().collect()]
        seen, page, pages = [], b.page(), []
        while page:
            pages.append([r.id for r in page.rows])
            seen += pages[-1]
            last, page = page, page.next()
        assert seen == expected
        back = last.prev()
        assert [r.id for r in back.rows] == pages[-2]
    with pytest.raises(CursorError):
        db.query("t").where("g", "=", 1).limit(5).cursor(b.page().next_cursor).page()


def test_joins_and_groups(db):
    db.batch_insert("posts", [{"title": "a", "user_id": 1}, {"title": "b", "user_id": 1}])
    rows = db.query("posts").join_referenced_table("users").df()
    assert set(rows.columns) == {"posts.id", "title", "user_id", "users.id", "username", "email", "age", "fans", "seen"}
    counts = db.query("users").join_referencing_table("posts").select(["username", Agg.count_non_null("title", "n")]).group_by(["username"]).df()
    assert {r.username: r.n for r in counts.collect()}["user_1"] == 2
    assert db.query("users").select([Agg.min("username")]).df().first()[0] is None


def test_transactions_and_cache(db):
    with pytest.raises(RuntimeError), db.transaction():
        db.delete("posts").allow_delete_all().run()
        db.update("users", {"age": 0}).allow_update_all().run()
        raise RuntimeError
    assert db.query("users").where("age", "=", 0).count() == 0
    q = db.query("users").where("age", ">", 0).use_query_cache()
    assert q.df().count() == 5
    with db.transaction():
        db.update("users", {"age": 0}).where("id", "=", 1).run()
        assert db.query("users").where("age", "=", 0).count() == 1
    assert q.df().count() == 4
    seen = []
    for rows in db.query("users").where("age", "=", 0).watch(timeout=0.2):
        seen.append(len(rows))
        if len(seen) == 1:
            db.update("users", {"age": 0}).where("id", "=", 2).run()
    assert seen == [1, 2]


def test_disk_backup_and_evolution(spark, tmp_path):
    path = str(tmp_path)
    db = Database.open(spark, path, schemas=[USERS])
    db.batch_insert("users", [{"username": "a", "age": 3}, {"username": "b"}])
    again = Database.open(spark, path)
    assert again.query("users").count() == 2 and again.schema("users") == USERS
    again.backup(f"{path}/copy")
    again.delete("users").where("username", "=", "a").run()
    assert Database.open(spark, path).query("users").count() == 1
    again.restore(f"{path}/copy")
    assert again.query("users").count() == 2
    fields = (Field("login", T.text, nullable=False, unique=True, field_id="username"), Field("email", T.text), Field("age", T.text), Field("tier", T.text, default="standard"))
    newer = Table("users", fields, indexes=USERS.indexes)
    older = Table("users", tuple(f if f.name != "username" else Field("username", T.text, nullable=False, unique=True, field_id="username") for f in USERS.fields), indexes=USERS.indexes)
    db2 = Database.memory(spark, [older])
    db2.batch_insert("users", [{"username": "a", "age": 3}])
    db2.declare([newer])
    assert db2.query("users").first().asDict() == {"id": 1, "login": "a", "email": None, "age": "3", "tier": "standard"}
    task = db2.update_schema("users").rename_table("people").run()
    assert db2.query_migration_task_status(task)["state"] == "done" and db2.table_exists("people")
    db2.switch_space("other")
    assert not db2.table_exists("people") and db2.list_spaces() == ["default"]


def test_lifetime_and_key_values(spark):
    now = dt.datetime(2024, 1, 1)
    db = Database.memory(spark, [Table("logs", (Field("at", T.datetime),), ttl=Ttl(1000, "at"))])
    db.batch_insert("logs", [{"at": now - dt.timedelta(seconds=1)}, {"at": now}])
    assert db.cleanup_ttl("logs", now).success_keys == ["1"]  # exactly as old as its lifetime: over
    kv = KeyValues(db, now)
    kv.set("a", {"x": 1})
    kv.set("b", 5, expires_at=now)
    assert kv.get("a") == {"x": 1} and kv.get("b") is None and kv.count() == 2 and kv.get_keys() == ["a"]
    kv.set_increment("n", 3)
    kv.set_increment("n", 4)
    assert kv.get_int("n") == 7
    assert kv.set("c", 1, ttl=dt.timedelta(1), expires_at=now).is_failed
    kv.set_ttl("a", dt.timedelta(seconds=9))
    assert kv.get_ttl("a") == dt.timedelta(seconds=9)
    kv.remove("a")
    assert not kv.exists("a")
    kv.clear()
    assert kv.count() == 0
    assert db.frame("logs").select(F.count(F.lit(1))).first()[0] == 1


def test_condition_reuse_in_builder(db):
    c = Condition().where("age", ">", 20)
    assert len(names(db.query("users").condition(c).where("age", "<", 50))) == 2


def test_generated_key_kinds(spark):
    from quernel.functions import crypto
    from quernel.schema import KeyKind, PrimaryKey

    for kind, type_, width in ((KeyKind.timestampBased, T.integer, 18), (KeyKind.datePrefixed, T.integer, 19), (KeyKind.shortCode, T.text, 10)):
        db = Database.memory(spark, [Table("t", (Field("a", T.integer),), PrimaryKey("id", kind, type=type_))])
        for _ in range(2):
            assert db.batch_insert("t", [{"a": 1}, {"a": 2}]).is_success
        ids = [str(r.id) for r in db.frame("t").collect()]
        assert len(set(ids)) == 4 and {len(i) for i in ids} == {width}
    frame = spark.createDataFrame([("x",), ("é",), (None,)], "v string")
    coded = frame.select("v", crypto.encode(F.col("v"), "k").alias("c"))
    assert [r.v for r in coded.select(crypto.decode(F.col("c"), "k").alias("v")).collect()] == ["x", "é", None]
    assert {r.v for r in coded.select(crypto.decode(F.col("c"), "other").alias("v")).collect()} == {None}


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "concat('n', id) as s", "id * 2 as x", "id * 3 as unused").write.parquet(f"{tmp_path}/t.parquet")
    db = Database.over(spark, str(tmp_path), [Table("t", (Field("s", T.text), Field("x", T.integer), Field("unused", T.integer)))])
    plan = db.query("t").where("x", ">", 10).where_starts_with("s", "n1").select(["id"]).df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,10)" in plan and "StringStartsWith(s,n1)" in plan and "unused" not in plan
    top = db.query("t").order_by_desc("x").limit(3).select(["id"]).df()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
