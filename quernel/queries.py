"""The registered queries of the engine over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.engine import Database
from quernel.functions import expr as X
from quernel.functions import keys, vectors
from quernel.operators import constraints, lifetime, vector_search
from quernel.operators import write as W
from quernel.plans.aggregate import Agg
from quernel.plans.condition import Condition
from quernel.schema import Action, Field, FieldType, ForeignKey, KeyKind, PrimaryKey, Table

NOW = dt.datetime(2024, 1, 20)


def _t(name: str, key: str, fields: str, fks: tuple[ForeignKey, ...] = ()) -> Table:
    kinds = {"i": FieldType.integer, "d": FieldType.double, "s": FieldType.text, "t": FieldType.datetime, "a": FieldType.array}
    return Table(name, tuple(Field(*(lambda n, k: (n, kinds[k]))(*f.split(":"))) for f in fields.split()), PrimaryKey(key, KeyKind.none), foreign_keys=fks)


def _fk(field: str, table: str, ref: str, delete: Action = Action.cascade, update: Action = Action.cascade) -> ForeignKey:
    return ForeignKey((field,), table, (ref,), on_delete=delete, on_update=update)


SCHEMAS = [
    _t("region", "r_regionkey", "r_name:s"),
    _t("nation", "n_nationkey", "n_name:s n_regionkey:i", (_fk("n_regionkey", "region", "r_regionkey"),)),
    _t("customer", "c_custkey", "c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s", (_fk("c_nationkey", "nation", "n_nationkey"),)),
    _t("supplier", "s_suppkey", "s_name:s s_nationkey:i s_acctbal:d", (_fk("s_nationkey", "nation", "n_nationkey"),)),
    _t("part", "p_partkey", "p_name:s p_brand:s p_type:s p_size:i p_retailprice:d"),
    _t("orders", "o_orderkey", "o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s", (_fk("o_custkey", "customer", "c_custkey"),)),
    _t("events", "event_id", "ts:t user_id:i event_type:s value:d props:s"),
    _t("documents", "doc_id", "text:s lang:s source:s n_chars:i"),
    _t("labels", "doc_id", "quality:i toxic:i"),
    _t("embeddings", "vec_id", "embedding:a label:i"),
]
#: ``lineitem`` has no single key; its rows are told apart by four columns, so the table declares none that is generated.
LINEITEM = _t("lineitem", "l_orderkey", "l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t", (_fk("l_orderkey", "orders", "o_orderkey"), ForeignKey(("l_partkey",), "part", ("p_partkey",))))

FOUND: dict[str, tuple[Callable[[Database], DataFrame], str | None]] = {}


def database(spark: SparkSession, sf_dir: str) -> Database:
    return Database.over(spark, sf_dir, [*SCHEMAS, LINEITEM])


def q(name: str, sql: str | None = None):
    def put(f: Callable[[Database], DataFrame]):
        FOUND[name] = (f, sql)
        return f

    return put


def r2(col: str, name: str | None = None):
    return F.round(F.col(f"`{col}`"), 2).alias(name or col)


ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
O = ORDERS.split(", ")  # noqa: E741

# -- scans, keys, projection ---------------------------------------------------------------------------------------
q("scan_all", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda d: d.query("nation").df())
q("pk_lookup", f"SELECT {ORDERS} FROM orders WHERE o_orderkey = 77")(lambda d: d.query("orders").where("o_orderkey", "=", 77).select(O).df())
q("pk_in", f"SELECT {ORDERS} FROM orders WHERE o_orderkey IN (1, 5, 9, 1000000000)")(lambda d: d.query("orders").where_in("o_orderkey", [1, 5, 9, 10**9]).select(O).df())
q("pk_range", f"SELECT {ORDERS} FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")(lambda d: d.query("orders").where("o_orderkey", ">=", 100).where("o_orderkey", "<", 300).select(O).df())
q("filter_eq_indexed", f"SELECT {ORDERS} FROM orders WHERE o_custkey = 42")(lambda d: d.query("orders").where_equal("o_custkey", 42).select(O).df())
q("select_cols", "SELECT p_partkey, p_name FROM part")(lambda d: d.query("part").select(["p_partkey", "p_name"]).df())
q("select_alias", "SELECT p_partkey AS id, p_name AS title FROM part")(lambda d: d.query("part").select(["p_partkey as id", "p_name AS title"]).df())
q("stream_filter_select", "SELECT event_id, event_type FROM events WHERE value > 50")(lambda d: d.stream_query("events").where("value", ">", 50).select(["event_id", "event_type", "no_such_field"]).df())

# -- predicates ----------------------------------------------------------------------------------------------------
for _name, _build, _sql in [
    ("filter_eq", lambda b: b.where("o_orderstatus", "=", "F"), "o_orderstatus = 'F'"),
    ("filter_ne", lambda b: b.where("o_orderstatus", "!=", "F"), "o_orderstatus IS DISTINCT FROM 'F'"),
    ("filter_gt", lambda b: b.where("o_totalprice", ">", 200000), "o_totalprice > 200000"),
    ("filter_gte", lambda b: b.where_greater_than_or_equal_to("o_orderkey", 500), "o_orderkey >= 500"),
    ("filter_lt", lambda b: b.where_less_than("o_totalprice", 50000), "o_totalprice < 50000"),
    ("filter_lte", lambda b: b.where_less_than_or_equal_to("o_orderkey", 500), "o_orderkey <= 500"),
    ("filter_in", lambda b: b.where_in("o_orderpriority", ["1-URGENT", "5-LOW"]), "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    ("filter_not_in", lambda b: b.where_not_in("o_orderpriority", ["1-URGENT", "5-LOW"]), "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
    ("filter_between", lambda b: b.where_between("o_totalprice", 100000, 150000), "o_totalprice BETWEEN 100000 AND 150000"),
    ("filter_like", lambda b: b.where_like("o_orderpriority", "_-%H%"), "o_orderpriority LIKE '_-%H%'"),
    ("filter_not_like", lambda b: b.where_not_like("o_orderpriority", "%-%O%"), "o_orderpriority NOT LIKE '%-%O%'"),
    ("filter_not_null", lambda b: b.where_not_null("o_orderstatus"), "o_orderstatus IS NOT NULL"),
    ("filter_null", lambda b: b.where_null("o_orderstatus"), "o_orderstatus IS NULL"),
    ("filter_and", lambda b: b.where("o_orderstatus", "=", "O").where("o_totalprice", ">", 100000), "o_orderstatus = 'O' AND o_totalprice > 100000"),
    ("filter_or", lambda b: b.where("o_orderstatus", "=", "P").or_where("o_totalprice", ">", 250000), "o_orderstatus = 'P' OR o_totalprice > 250000"),
    ("filter_or_precedence", lambda b: b.where("o_orderstatus", "=", "P").or_().where("o_totalprice", ">", 250000).where("o_custkey", "<", 700), "o_orderstatus = 'P' OR (o_totalprice > 250000 AND o_custkey < 700)"),
    ("filter_nested", lambda b: b.where("o_totalprice", ">", 80000).condition(Condition().where("o_orderstatus", "=", "F").or_where("o_orderpriority", "=", "1-URGENT")), "o_totalprice > 80000 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')"),
    ("filter_or_condition", lambda b: b.where("o_orderkey", "<", 50).or_condition(Condition().where("o_orderstatus", "=", "F").where("o_custkey", "<", 20)), "o_orderkey < 50 OR (o_orderstatus = 'F' AND o_custkey < 20)"),
    ("filter_from_map", lambda b: b.condition(Condition.from_map({"AND": [{"o_totalprice": {">": 60000, "<": 90000}}, {"OR": [{"o_orderstatus": "O"}, {"o_custkey": {"<=": 100}}]}]})), "o_totalprice > 60000 AND o_totalprice < 90000 AND (o_orderstatus = 'O' OR o_custkey <= 100)"),
    ("filter_coerce", lambda b: b.where("o_orderkey", "=", " 77 ").or_where("o_totalprice", ">", "240000"), "o_orderkey = 77 OR o_totalprice > 240000"),
]:
    q(_name, f"SELECT {ORDERS} FROM orders WHERE {_sql}")(lambda d, f=_build: f(d.query("orders")).select(O).df())

for _name, _build, _sql in [
    ("filter_contains", lambda b: b.where_contains("p_name", "a"), "p_name LIKE '%a%'"),
    ("filter_not_contains", lambda b: b.where_not_contains("p_name", "e"), "p_name NOT LIKE '%e%'"),
    ("filter_starts_with", lambda b: b.where_starts_with("p_brand", "Brand#1"), "starts_with(p_brand, 'Brand#1')"),
    ("filter_ends_with", lambda b: b.where_ends_with("p_brand", "3"), "suffix(p_brand, '3')"),
    ("filter_contains_any", lambda b: b.where("p_size", "<", 30).where_contains_any("p_type", ["EEL", "TIN"]), "p_size < 30 AND (p_type LIKE '%EEL%' OR p_type LIKE '%TIN%')"),
    ("filter_or_contains_any", lambda b: b.where("p_size", "<", 10).or_contains_any("p_type", ["EEL", "TIN"]), "p_size < 10 OR p_type LIKE '%EEL%' OR p_type LIKE '%TIN%'"),
]:
    q(_name, f"SELECT p_partkey, p_name, p_brand FROM part WHERE {_sql}")(lambda d, f=_build: f(d.query("part")).select(["p_partkey", "p_name", "p_brand"]).df())

q("filter_like_multiline", "SELECT doc_id FROM documents WHERE text LIKE '%a%e%'")(lambda d: d.query("documents").where_like("text", "%a%e%").select(["doc_id"]).df())


def _nulls(d: Database) -> DataFrame:
    """Orders with some statuses null and some empty, since the tables hold no nulls."""
    k = F.col("o_orderkey")
    return d.frame("orders").select("o_orderkey", F.when(k % 7 == 0, None).when(k % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("s"))


NULLS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS s FROM orders)"
for _name, _build, _sql in [
    ("filter_ne_null", lambda c: c.where("s", "!=", "F"), "s IS DISTINCT FROM 'F'"),
    ("filter_not_in_null", lambda c: c.where_not_in("s", ["F", "O"]), "s IS NULL OR s NOT IN ('F', 'O')"),
    ("filter_not_like_null", lambda c: c.where_not_like("s", "F%"), "s NOT LIKE 'F%'"),
    ("filter_empty", lambda c: c.where_empty("s"), "s IS NULL OR s = ''"),
    ("filter_not_empty", lambda c: c.where_not_empty("s"), "s IS NOT NULL AND s <> ''"),
    ("filter_is_null", lambda c: c.where_null("s"), "s IS NULL"),
]:

    def _on_nulls(d: Database, f=_build) -> DataFrame:
        frame = _nulls(d)
        return frame.where(f(Condition()).to_column(W.resolver(frame)))

    q(_name, f"SELECT o_orderkey, s FROM {NULLS} t WHERE {_sql}")(_on_nulls)

for _name, _flag in (("filter_true", True), ("filter_false", False)):

    def _bool(d: Database, flag=_flag) -> DataFrame:
        frame = d.frame("orders").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("big"))
        c = Condition()
        return frame.where((c.where_true("big") if flag else c.where_false("big")).to_column(W.resolver(frame)))

    q(_name, f"SELECT o_orderkey, o_totalprice > 150000 AS big FROM orders WHERE (o_totalprice > 150000) = {str(_flag).lower()}")(_bool)

# -- joins ---------------------------------------------------------------------------------------------------------
q("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(lambda d: d.query("orders").join("customer", "o_custkey", "=", "c_custkey").select(["o_orderkey", "c_name"]).df())
q("join_theta", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")(lambda d: d.query("nation").join("region", "n_regionkey", "<", "r_regionkey").select(["n_name", "r_name"]).df())
q("join_theta_ne", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey <> r_regionkey")(lambda d: d.query("nation").join("region", "n_regionkey", "<>", "r_regionkey").select(["n_name", "r_name"]).df())
q("join_left", "SELECT d.doc_id AS did, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(lambda d: d.query("documents").left_join("labels", "doc_id", "=", "labels.doc_id").select(["documents.doc_id as did", "quality"]).df())
q("join_left_theta", "SELECT r_name, n_name FROM region LEFT JOIN nation ON r_regionkey > n_nationkey")(lambda d: d.query("region").left_join("nation", "r_regionkey", ">", "n_nationkey").select(["r_name", "n_name"]).df())
q("join_right", "SELECT l.quality AS quality, d.doc_id AS did FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")(lambda d: d.query("labels").right_join("documents", "doc_id", "=", "documents.doc_id").select(["quality", "documents.doc_id as did"]).df())
q("join_fk_parent", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(lambda d: d.query("orders").join_referenced_table("customer").select(["o_orderkey", "c_name"]).df())
q("join_fk_child", "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey")(lambda d: d.query("region").join_referencing_table("nation").select(["r_name", "n_name"]).df())
q("join_fk_auto", "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")(lambda d: d.query("supplier").join_with_foreign_key("nation").select(["s_name", "n_name"]).df())
q("join_multi", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda d: d.query("orders").join("customer", "o_custkey", "=", "c_custkey").join("nation", "customer.c_nationkey", "=", "n_nationkey").join("region", "n_regionkey", "=", "r_regionkey").select(["o_orderkey", "c_name", "n_name", "r_name"]).df()
)
q("join_where_other", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000")(
    lambda d: d.query("orders").join("customer", "o_custkey", "=", "c_custkey").where("customer.c_mktsegment", "=", "BUILDING").where("o_totalprice", ">", 100000).select(["o_orderkey", "c_mktsegment"]).df()
)
q("join_order_by", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY c_name DESC, o_orderkey LIMIT 40")(
    lambda d: d.query("orders").join("customer", "o_custkey", "=", "c_custkey").order_by_desc("customer.c_name").limit(40).select(["o_orderkey", "c_name"]).df()
)
q("join_select_qualified", 'SELECT o.o_orderkey AS "orders.o_orderkey", c.c_name AS name FROM orders o JOIN customer c ON o_custkey = c_custkey')(
    lambda d: d.query("orders").join("customer", "o_custkey", "=", "c_custkey").select(["orders.o_orderkey", "customer.c_name as name"]).df()
)
q("join_conflict_names", 'SELECT d.doc_id AS "documents.doc_id", l.doc_id AS "labels.doc_id", lang, source, n_chars, quality, toxic, text FROM documents d JOIN labels l ON d.doc_id = l.doc_id')(lambda d: d.query("documents").join("labels", "doc_id", "=", "labels.doc_id").df())


@q("join_fk_composite", "SELECT a.l_partkey AS partkey, a.l_suppkey AS suppkey, n, q FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_partkey, l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_fk_composite(d: Database) -> DataFrame:
    """A two-column foreign key between two tables derived from lineitem."""
    db = Database(d.spark)
    line = d.frame("lineitem")
    for name, frame, field in (("supply", line.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")), "n:i"), ("returned", line.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("q")), "q:d")):
        fks = (ForeignKey(("l_partkey", "l_suppkey"), "supply", ("l_partkey", "l_suppkey")),) if name == "returned" else ()
        db.schemas[("default", name)] = _t(name, f"{name}_id", f"l_partkey:i l_suppkey:i {field}", fks)
        db.frames[("default", name)] = frame
    return db.query("returned").join_referenced_table("supply").select(["supply.l_partkey as partkey", "supply.l_suppkey as suppkey", "n", "q"]).df()


# -- aggregates ----------------------------------------------------------------------------------------------------
q("agg_count", "SELECT count(*) AS n FROM orders")(lambda d: d.query("orders").select([Agg.count("o_orderstatus", "n")]).df())
q("agg_sum", "SELECT round(sum(o_totalprice), 2) AS s FROM orders")(lambda d: d.query("orders").select([Agg.sum("o_totalprice", "s")]).df().select(r2("s")))
q("agg_avg", "SELECT round(avg(o_totalprice), 2) AS a FROM orders")(lambda d: d.query("orders").select([Agg.avg("o_totalprice", "a")]).df().select(r2("a")))
q("agg_min", "SELECT min(p_size) AS m FROM part")(lambda d: d.query("part").select([Agg.min("p_size", "m")]).df())
q("agg_max", "SELECT max(p_retailprice) AS m FROM part")(lambda d: d.query("part").select([Agg.max("p_retailprice", "m")]).df())
q("agg_min_text", "SELECT CAST(NULL AS DOUBLE) AS m, min(p_name) AS native FROM part")(lambda d: d.query("part").select([Agg.min("p_name", "m"), Agg.min("p_name", "native", native=True)]).df())
q("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS disc, max(l_tax) AS tax FROM lineitem")(
    lambda d: d.query("lineitem").select([Agg.count(alias="n"), Agg.sum("l_quantity", "q"), Agg.avg("l_discount", "disc"), Agg.max("l_tax", "tax")]).df().select("n", r2("q"), F.round("disc", 6).alias("disc"), "tax")
)
q("agg_default_name", 'SELECT p_brand, round(sum(p_retailprice), 2) AS "sum(p_retailprice)", count(*) AS "count(*)" FROM part GROUP BY p_brand')(
    lambda d: d.query("part").select(["p_brand", Agg.sum("p_retailprice"), Agg.count()]).group_by(["p_brand"]).df().select("p_brand", r2("sum(p_retailprice)"), "`count(*)`")
)
q("agg_json_path", "SELECT event_type, round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 2) AS k FROM events GROUP BY event_type")(
    lambda d: d.query("events").select(["event_type", Agg.sum("props.k", "k")]).group_by(["event_type"]).df().select("event_type", r2("k"))
)
q("group_by_one", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag")(
    lambda d: d.query("lineitem").select(["l_returnflag", Agg.count(alias="n"), Agg.sum("l_extendedprice", "s")]).group_by(["l_returnflag"]).df().select("l_returnflag", "n", r2("s"))
)
q("group_by_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY ALL")(
    lambda d: d.query("lineitem").select(["l_returnflag", "l_linestatus", Agg.count(alias="n"), Agg.avg("l_quantity", "a")]).group_by(["l_returnflag", "l_linestatus"]).df().select("l_returnflag", "l_linestatus", "n", F.round("a", 4).alias("a"))
)
q("group_by_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")(lambda d: d.query("orders").select(["o_custkey", Agg.count(alias="n")]).group_by(["o_custkey"]).having(Condition().where("n", ">", 12)).df())
q("group_by_having_agg", 'SELECT o_custkey, count(*) AS "count(*)" FROM orders GROUP BY o_custkey HAVING count(*) < 4')(lambda d: d.query("orders").select(["o_custkey", Agg.count()]).group_by(["o_custkey"]).having(Condition().where(Agg.count(), "<", 4)).df())
q("group_by_no_agg", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(lambda d: d.query("orders").group_by(["o_orderstatus", "o_orderpriority"]).df())
q("group_by_limit", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")(lambda d: d.query("orders").select(["o_custkey", Agg.count(alias="n")]).group_by(["o_custkey"]).order_by_desc("n").order_by_asc("o_custkey").limit(10).df())
q("group_by_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")(lambda d: d.query("customer").join("nation", "c_nationkey", "=", "n_nationkey").where("c_acctbal", ">", 0).select(["n_name", Agg.count(alias="n")]).group_by(["n_name"]).df())
q("distinct_rows", "SELECT DISTINCT p_brand, p_size FROM part")(lambda d: d.query("part").select(["p_brand", "p_size"]).distinct().df())
q("distinct_on", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rn FROM part) t WHERE rn = 1")(
    lambda d: d.query("part").distinct(["p_brand"]).order_by_asc("p_retailprice").select(["p_brand", "p_partkey", "p_retailprice"]).df()
)
q("distinct_on_mixed", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) t WHERE rn = 1")(
    lambda d: d.query("part").distinct(["p_brand"]).order_by_desc("p_retailprice").select(["p_brand", "p_partkey", "p_retailprice"]).df()
)
for _n, _f in {
    "count_all": (lambda b: b.count(), "SELECT count(*) AS x FROM orders"),
    "count_filtered": (lambda b: b.where("o_totalprice", ">", 100000).count(), "SELECT count(*) AS x FROM orders WHERE o_totalprice > 100000"),
    "exists": (lambda b: b.where("o_totalprice", ">", 10**9).exists(), "SELECT count(*) > 0 AS x FROM orders WHERE o_totalprice > 1000000000"),
    "scalar_sum": (lambda b: round(b.sum("o_totalprice"), 2), "SELECT round(sum(o_totalprice), 2) AS x FROM orders"),
    "scalar_avg": (lambda b: round(b.avg("o_totalprice"), 4), "SELECT round(avg(o_totalprice), 4) AS x FROM orders"),
    "scalar_min": (lambda b: b.min("o_totalprice"), "SELECT min(o_totalprice) AS x FROM orders"),
    "scalar_max": (lambda b: b.max("o_custkey"), "SELECT max(o_custkey) AS x FROM orders"),
    "first_row": (lambda b: b.order_by_asc("o_orderkey").first().o_custkey, "SELECT o_custkey AS x FROM orders ORDER BY o_orderkey LIMIT 1"),
}.items():
    q(_n, _f[1])(lambda d, f=_f[0]: d.spark.createDataFrame([(f(d.query("orders")),)], ["x"]))

# -- order, limit, paging ------------------------------------------------------------------------------------------
OP = "o_orderkey, o_totalprice"
q("order_asc", f"SELECT {OP} FROM orders ORDER BY o_totalprice, o_orderkey")(lambda d: d.query("orders").order_by_asc("o_totalprice").select(OP.split(", ")).df())
q("order_desc", f"SELECT {OP} FROM orders ORDER BY o_totalprice DESC, o_orderkey")(lambda d: d.query("orders").order_by("-o_totalprice").select(OP.split(", ")).df())
q("order_multi", f"SELECT {OP} FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")(lambda d: d.query("orders").order_by("o_orderstatus ASC").order_by("o_totalprice DESC").select(OP.split(", ")).df())
q("top_k", f"SELECT {OP} FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda d: d.query("orders").where("o_orderstatus", "=", "O").order_by_desc("o_totalprice").limit(10).select(OP.split(", ")).df())
q("limit_n", f"SELECT {OP} FROM orders ORDER BY o_orderkey LIMIT 25")(lambda d: d.query("orders").limit(25).select(OP.split(", ")).df())
q("offset_limit", f"SELECT {OP} FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 30")(lambda d: d.query("orders").order_by_asc("o_totalprice").offset(30).limit(20).select(OP.split(", ")).df())


@q("order_nulls", f"SELECT o_orderkey, s FROM {NULLS} t ORDER BY s ASC NULLS FIRST, o_orderkey")
def order_nulls(d: Database) -> DataFrame:
    db = Database(d.spark)
    db.schemas[("default", "t")], db.frames[("default", "t")] = _t("t", "o_orderkey", "s:s"), _nulls(d)
    return db.query("t").order_by_asc("s").df()


@q("keyset_page2", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 15 OFFSET 15")
def keyset_page2(d: Database) -> DataFrame:
    page = d.query("orders").order_by_desc("o_orderpriority").select(["o_orderkey", "o_orderpriority"]).limit(15)
    return page.clone().cursor(page.page().next_cursor).df().select("o_orderkey", "o_orderpriority")


@q("keyset_prev", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 15 OFFSET 15")
def keyset_prev(d: Database) -> DataFrame:
    """Two pages forward and one back: the second page again."""
    third = d.query("orders").order_by_asc("o_orderpriority").select(["o_orderkey", "o_orderpriority"]).limit(15).page().next().next()
    return d.spark.createDataFrame(third.prev().rows, "o_orderkey long, o_orderpriority string")


# -- expressions ---------------------------------------------------------------------------------------------------
def _expr(name: str, e: X.Expr, sql: str, digits: int | None = 6):
    def run(d: Database) -> DataFrame:
        frame = d.frame("part").select("p_partkey", "p_size", "p_retailprice", "p_name", F.when(F.col("p_size") % 4 == 0, None).otherwise(F.col("p_size")).alias("n"))
        x = X.compile_expr(e, W.resolver(frame))
        return frame.select("p_partkey", (F.round(x, digits) if digits else x).alias("x"))

    q(name, f"SELECT p_partkey, {f'round({sql}, {digits})' if digits else sql} AS x FROM (SELECT *, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS n FROM part) t")(run)


f_ = X.field
_expr("expr_field_null", f_("n") + f_("p_name"), "CAST(coalesce(n, 0) AS DOUBLE) + coalesce(TRY_CAST(p_name AS DOUBLE), 0)")
_expr("expr_arith", (f_("p_size") * 3 - f_("p_retailprice")) + 1.5, "p_size * 3 - p_retailprice + 1.5")
_expr("expr_div_zero", f_("p_retailprice") / f_("n"), "CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE p_retailprice / n END")
_expr("expr_mod", (f_("p_size") - 25) % 7, "CAST((((p_size - 25) % 7) + 7) % 7 AS BIGINT)", None)
_expr("expr_abs", abs(-(f_("p_size") - 25)), "CAST(abs(p_size - 25) AS BIGINT)", None)
_expr("expr_min_max", X.greatest(X.least(f_("n"), 20), 5), "CAST(greatest(least(coalesce(n, 0), 20), 5) AS BIGINT)", None)
_expr("expr_round", X.rounded(f_("p_retailprice") * 1.1), "CAST(round(p_retailprice * 1.1) AS BIGINT)", None)
_expr("expr_floor_ceil", X.floor(f_("p_retailprice") / 7) + X.ceil(f_("p_retailprice") / 3), "CAST(floor(p_retailprice / 7) AS BIGINT) + CAST(ceil(p_retailprice / 3) AS BIGINT)", None)
_expr("expr_if_else", X.if_else(f_("n"), f_("p_size") * 2, -1), "CAST(CASE WHEN coalesce(n, 0) <> 0 THEN p_size * 2 ELSE -1 END AS BIGINT)", None)
_expr("expr_when", X.when(f_("p_name"), f_("p_size"), 0), "CAST(CASE WHEN p_name <> '' THEN p_size ELSE 0 END AS BIGINT)", None)

# -- vectors -------------------------------------------------------------------------------------------------------
QV = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
VEC = f"(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, q FROM embeddings, {QV})"


def _query_vector(d: Database) -> list[float]:
    return [float(x) for x in d.query("embeddings").where("vec_id", "=", 0).first().embedding]


for _m, _d, _s in (
    ("cosine", "1 - list_cosine_similarity(v, q)", "least(greatest(1 - d, 0.0), 1.0)"),
    ("l2", "list_distance(v, q)", "1 / (1 + d)"),
    ("ip", "-list_inner_product(v, q)", "1 / (1 + exp(d))"),
):

    def _topk(d: Database, m=_m) -> DataFrame:
        out = vector_search.search(d.frame("embeddings"), "embedding", _query_vector(d), 10, m, "vec_id")
        return out.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))

    q(f"vector_topk_{_m}", f"SELECT vec_id, round(d, 6) AS distance, round({_s}, 6) AS score FROM (SELECT vec_id, {_d} AS d FROM {VEC} t) u ORDER BY d, vec_id LIMIT 10")(_topk)



@q("vector_ann", "SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, 1 - list_cosine_similarity(v, q) AS d FROM " + VEC + " t) u ORDER BY d, vec_id LIMIT 1")
def vector_ann(d: Database) -> DataFrame:
    """The nearest row through the index: rows that codes do not rule out are ranked by exact distance."""
    out = d.vector_search("embeddings", "embedding", _query_vector(d), 1, "cosine", ef_search=64)
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


q("vector_threshold", f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, list_distance(v, q) AS d FROM {VEC} t) u WHERE d <= 1.2")(
    lambda d: vector_search.search(d.frame("embeddings"), "embedding", _query_vector(d), 10**6, "l2", "vec_id", 1.2).select("vec_id", F.round("distance", 6).alias("distance"))
)
q("vector_score", f"SELECT vec_id, round(1 / (1 + list_distance(v, q)), 6) AS score FROM {VEC} t")(
    lambda d: d.frame("embeddings").select("vec_id", F.round(vectors.score("l2", vectors.l2(F.col("embedding"), F.array(*map(F.lit, _query_vector(d))))), 6).alias("score"))
)


def _vec(name: str, make, sql: str):
    def run(d: Database) -> DataFrame:
        return d.frame("embeddings").select("vec_id", make(F.col("embedding"), F.array(*map(F.lit, _query_vector(d)))).alias("x"))

    q(name, f"SELECT vec_id, {sql} AS x FROM {VEC} t")(run)


_vec("vec_dot", lambda a, b: F.round(vectors.dot(a, b), 6), "round(list_inner_product(v, q), 6)")
_vec("vec_cosine", lambda a, b: F.round(vectors.cosine(a, b), 6), "round(list_cosine_similarity(v, q), 6)")
_vec("vec_l2", lambda a, b: F.round(vectors.l2(a, b), 6), "round(list_distance(v, q), 6)")
_vec("vec_manhattan", lambda a, b: F.round(vectors.manhattan(a, b), 5), "round(list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2]))), 5)")
_vec("vec_norm", lambda a, b: F.round(vectors.norm(vectors.scale(a, 3)), 5), "round(3 * sqrt(list_inner_product(v, v)), 5)")
_vec("vec_add", lambda a, b: F.round(vectors.dot(vectors.add(a, b), vectors.subtract(a, vectors.scale(b, -1))), 5), "round(list_inner_product(v, v) + 2 * list_inner_product(v, q) + list_inner_product(q, q), 5)")
_vec("vec_normalize", lambda a, b: F.round(vectors.dot(vectors.normalize(a), b), 6), "round(list_inner_product(v, q) / sqrt(list_inner_product(v, v)), 6)")
_vec("vec_subvector", lambda a, b: F.round(vectors.dot(vectors.subvector(a, 4, 8), vectors.subvector(b, 4, 8)), 6), "round(list_inner_product(v[5:12], q[5:12]), 6)")
_vec("vec_concat", lambda a, b: F.round(vectors.norm(vectors.concat(vectors.doubles(a), vectors.truncate(b, 16))), 5), "round(sqrt(list_inner_product(v, v) + list_inner_product(q[1:16], q[1:16])), 5)")

# -- writes --------------------------------------------------------------------------------------------------------
SUPPLIER = SCHEMAS[3].with_(key=PrimaryKey("s_suppkey", KeyKind.none))
S4 = "s_suppkey, s_name, s_nationkey, s_acctbal"


def _incoming(d: Database) -> DataFrame:
    """Every third supplier with a new balance, and new suppliers 1,000,000 above those."""
    s = d.frame("supplier")
    third = s.where("s_suppkey % 3 = 0")
    return third.withColumn("s_acctbal", F.col("s_acctbal") + 1000).unionByName(third.withColumn("s_suppkey", F.col("s_suppkey") + 1000000)).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


INCOMING = "(SELECT s_suppkey, s_name, s_nationkey, s_acctbal + 1000 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 3 = 0)"


def _bal(df: DataFrame) -> DataFrame:
    return df.select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"), r2("s_acctbal"))


B4 = "s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(s_acctbal, 2) AS s_acctbal"
q("write_insert", f"SELECT {B4} FROM supplier UNION ALL SELECT 9999999, 'new', 3, 1.5")(lambda d: _bal(W.insert(d.frame("supplier"), d.spark.createDataFrame([(9999999, " new ", 3, 1.5)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), SUPPLIER).frame))
q("write_batch_insert", f"SELECT {B4} FROM supplier UNION ALL SELECT {B4} FROM {INCOMING} i WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")(lambda d: _bal(W.insert(d.frame("supplier"), _incoming(d), SUPPLIER).frame))
q("write_batch_insert_report", f"SELECT s_suppkey AS key, CASE WHEN s_suppkey IN (SELECT s_suppkey FROM supplier) THEN 'primary: taken' END AS error FROM {INCOMING} i")(lambda d: W.insert(d.frame("supplier"), _incoming(d), SUPPLIER).report.select("key", "error"))
q("write_batch_insert_strict", f"SELECT {B4} FROM supplier")(lambda d: _bal(W.insert(d.frame("supplier"), _incoming(d), SUPPLIER, allow_partial=False).frame))
q("write_upsert", f"SELECT {B4} FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT {B4} FROM {INCOMING} i")(lambda d: _bal(W.upsert(d.frame("supplier"), _incoming(d), SUPPLIER).frame))
q("write_batch_update", f"SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1000 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier")(lambda d: _bal(W.batch_update(d.frame("supplier"), _incoming(d).select("s_suppkey", "s_acctbal"), SUPPLIER).frame))
q("write_update_where", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debtor' ELSE s_name END AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier")(
    lambda d: _bal(W.update(d.frame("supplier"), SUPPLIER, Condition().where("s_acctbal", "<", 0), {"s_name": "debtor", "s_acctbal": 0}).frame)
)
q("write_update_increment", "SELECT s_suppkey, s_name, CAST(CASE WHEN s_suppkey > 5 THEN s_nationkey + 2 ELSE s_nationkey END AS BIGINT) AS s_nationkey, round(CASE WHEN s_suppkey > 5 THEN s_acctbal * 2 - 10 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier")(
    lambda d: _bal(d_update(d).where("s_suppkey", ">", 5).increment("s_nationkey", 2).multiply("s_acctbal", 2).decrement("s_acctbal", 10).apply())
)
q("write_update_clamp", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(greatest(0, least(5000, s_acctbal)), 2) AS s_acctbal FROM supplier")(lambda d: _bal(d_update(d).allow_update_all().clamp("s_acctbal", 0, 5000).apply()))
q("write_update_top_n", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(CASE WHEN s_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5 OFFSET 2) THEN -1 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier")(
    lambda d: _bal(W.update(d.frame("supplier"), SUPPLIER, Condition(), {"s_acctbal": -1}, order=[("s_acctbal", True)], limit=5, offset=2).frame)
)
q("write_delete_where", f"SELECT {B4} FROM supplier WHERE NOT (s_acctbal < 1000 OR s_nationkey = 3)")(lambda d: _bal(W.delete(d.frame("supplier"), SUPPLIER, Condition().where("s_acctbal", "<", 1000).or_where("s_nationkey", "=", 3)).frame))
q("write_delete_top_n", f"SELECT {B4} FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 7)")(lambda d: _bal(W.delete(d.frame("supplier"), SUPPLIER, Condition(), order=[("s_acctbal", False)], limit=7).frame))


def d_update(d: Database):
    """An update builder whose ``apply`` gives the new snapshot without committing it."""
    from quernel.engine import UpdateBuilder

    class Apply(UpdateBuilder):
        def apply(self) -> DataFrame:
            return W.update(d.frame("supplier"), SUPPLIER, self, self.changes, self.all).frame

    return Apply(d, "supplier")


@q("write_validate", "SELECT p_partkey AS key, CASE WHEN p_size < 5 THEN 'p_size: too small' WHEN length(p_name) > 0 AND p_size > 45 THEN 'p_size: too large' END AS error, left(p_name, 8) AS p_name FROM part")
def write_validate(d: Database) -> DataFrame:
    """Over-long names are cut, sizes out of range are errors."""
    s = Table("part", (Field("p_name", FieldType.text, max_length=8), Field("p_size", FieldType.integer, min_value=5, max_value=45)), PrimaryKey("p_partkey", KeyKind.none))
    return W.validate(d.frame("part").select("p_partkey", "p_name", "p_size"), s).select(F.col("p_partkey").alias("key"), F.col("_error").alias("error"), "p_name")


@q("write_batch_update_sparse", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'renamed' ELSE s_name END AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1000 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier")
def write_batch_update_sparse(d: Database) -> DataFrame:
    """Some rows supply a balance alone, some a name alone."""
    key = F.col("s_suppkey")
    given = F.when(key % 3 == 0, F.array(F.lit("s_suppkey"), F.lit("s_acctbal"))).otherwise(F.array(F.lit("s_suppkey"), F.lit("s_name")))
    rows = d.frame("supplier").where(key % 3 != 2).select("s_suppkey", F.when(key % 3 == 1, "renamed").alias("s_name"), F.when(key % 3 == 0, F.col("s_acctbal") + 1000).alias("s_acctbal"), given.alias("_given"))
    return _bal(W.batch_update(d.frame("supplier"), rows, SUPPLIER).frame)


@q("write_upsert_expr_rows", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(CASE s_suppkey % 3 WHEN 0 THEN s_acctbal + 100 WHEN 1 THEN s_acctbal * 2 ELSE 7 END, 2) AS s_acctbal FROM supplier")
def write_upsert_expr_rows(d: Database) -> DataFrame:
    """Each row has its own expression, or a plain value."""
    key = F.col("s_suppkey")
    rows = d.frame("supplier").select("s_suppkey", F.when(key % 3 == 2, 7.0).alias("s_acctbal"), F.when(key % 3 == 0, 0).when(key % 3 == 1, 1).alias("_x_s_acctbal"))
    balance = X.field("s_acctbal")
    return _bal(W.upsert(d.frame("supplier"), rows, SUPPLIER, {"s_acctbal": [balance + 100, balance * 2]}).frame)


@q("write_update_fk", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 1 THEN 1 ELSE n_regionkey END AS BIGINT) AS n_regionkey FROM nation")
def write_update_fk(d: Database) -> DataFrame:
    """Every other nation is sent to a region that does not exist, and stays."""
    s = d.schema("nation").with_(foreign_keys=(_fk("n_regionkey", "region", "r_regionkey"),))
    rows = d.frame("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 1, 1).otherwise(99).alias("n_regionkey"))
    out = W.batch_update(d.frame("nation"), rows, s, parents={"region": d.frame("region")}).frame
    return out.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_regionkey").cast("long").alias("n_regionkey"))


@q("write_upsert_unique", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 1 THEN 'F' || s_suppkey WHEN s_suppkey % 5 = 0 AND s_suppkey + 2 NOT IN (SELECT s_suppkey FROM supplier) THEN 'S' || (s_suppkey + 2) ELSE 'S' || s_suppkey END AS s_name FROM supplier")
def write_upsert_unique(d: Database) -> DataFrame:
    """Rows that ask for a name that another row has are refused."""
    s = SUPPLIER.with_(fields=tuple(dataclasses.replace(f, unique=f.name == "s_name") for f in SUPPLIER.fields))
    key = F.col("s_suppkey")
    old = d.frame("supplier").withColumn("s_name", F.concat(F.lit("S"), key))
    rows = old.where(key % 5 < 2).select("s_suppkey", F.when(key % 5 == 1, F.concat(F.lit("F"), key)).otherwise(F.concat(F.lit("S"), key + 2)).alias("s_name"))
    return W.upsert(old, rows, s).frame.select("s_suppkey", "s_name")


@q("upsert_counter", "SELECT user_id, n + coalesce(old, 0) AS hits FROM (SELECT user_id, 1 AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 1) a) x LEFT JOIN (SELECT user_id AS u, count(*) AS old FROM events WHERE event_id % 2 = 0 GROUP BY 1) y ON user_id = u UNION ALL SELECT user_id, count(*) FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1) GROUP BY 1")
def upsert_counter(d: Database) -> DataFrame:
    """A counter that starts at 1 and grows by 1: the insert sees no fields."""
    s = Table("hits", (Field("hits", FieldType.integer),), PrimaryKey("user_id", KeyKind.none))
    e = d.frame("events")
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    new = e.where("event_id % 2 = 1").select("user_id").distinct()
    return W.upsert(old, new, s, updates={"hits": X.if_else(X.is_update(), f_("hits") + 1, 1)}).frame


# -- constraints, keys, lifetime, key-value ------------------------------------------------------------------------
q("check_unique", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")(lambda d: constraints.duplicates(d.frame("orders"), ("o_custkey",)))
q("check_fk_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")(lambda d: constraints.orphans(d.frame("orders"), d.frame("customer").where("c_acctbal > 0"), _fk("o_custkey", "customer", "c_custkey")).select("o_orderkey"))
q("fk_children", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")(lambda d: constraints.children(d.frame("orders"), d.frame("customer").where("c_nationkey = 7"), _fk("o_custkey", "customer", "c_custkey")).select("o_orderkey", "o_custkey"))


@q("fk_restrict", "SELECT 'with' AS orders, EXISTS (SELECT * FROM orders) AS refused, (SELECT count(*) FROM customer) - CASE WHEN EXISTS (SELECT * FROM orders) THEN 0 ELSE (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) END AS customers_left UNION ALL SELECT 'without', false, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))")
def fk_restrict(d: Database) -> DataFrame:
    """Customers with orders may not go, those without may."""
    schemas = {s.name: s for s in SCHEMAS if s.name in ("customer", "orders")}
    schemas["orders"] = schemas["orders"].with_(foreign_keys=(_fk("o_custkey", "customer", "c_custkey", Action.restrict),))
    frames = {n: d.frame(n) for n in schemas}
    ordered = frames["orders"].select(F.col("o_custkey").alias("c_custkey")).distinct()
    out = []
    for name, how in (("with", "left_semi"), ("without", "left_anti")):
        refused = False
        try:
            left = constraints.cascade_delete(frames, schemas, "customer", frames["customer"].join(ordered, "c_custkey", how)).frames["customer"]
        except constraints.ConstraintError:
            refused, left = True, frames["customer"]
        out.append(left.agg(F.count(F.lit(1)).alias("customers_left")).select(F.lit(name).alias("orders"), F.lit(refused).alias("refused"), "customers_left"))
    return out[0].unionAll(out[1])


CHAIN = [s for s in SCHEMAS if s.name in ("region", "nation", "customer", "supplier", "orders")]


def _chain(d: Database) -> tuple[dict[str, DataFrame], dict[str, Table]]:
    return {s.name: d.frame(s.name) for s in CHAIN}, {s.name: s for s in CHAIN}


def _counts(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in sorted(frames):
        one = frames[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


GONE = "(SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"


@q("fk_cascade_delete", f"SELECT 'region' AS name, count(*) AS n FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey NOT IN {GONE} UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey NOT IN {GONE} UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey NOT IN {GONE}")
def fk_cascade_delete(d: Database) -> DataFrame:
    """Region 1 goes with its nations, their customers and suppliers, and those customers' orders."""
    frames, schemas = _chain(d)
    return _counts(constraints.cascade_delete(frames, schemas, "region", frames["region"].where("r_regionkey = 1")).frames)


@q("fk_cascade_update", "SELECT CAST(n_nationkey + 100 AS INT) AS n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation WHERE n_regionkey <> 2")
def fk_cascade_update(d: Database) -> DataFrame:
    """Nations of region 2 get keys 100 higher, and their customers follow."""
    frames, schemas = _chain(d)
    changes = frames["nation"].where("n_regionkey = 2").select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 100).alias("new"))
    out = constraints.cascade_update(frames, schemas, "nation", changes).frames
    per = out["customer"].groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return out["nation"].join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("customers"))


@q("fk_set_null", "SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def fk_set_null(d: Database) -> DataFrame:
    frames, schemas = _chain(d)
    schemas = {n: s.with_(foreign_keys=tuple(_fk(k.fields[0], k.table, k.referenced[0], Action.setNull) for k in s.foreign_keys)) for n, s in schemas.items()}
    return constraints.cascade_delete(frames, schemas, "nation", frames["nation"].where("n_nationkey = 7")).frames["customer"].select("c_custkey", "c_nationkey")


@q("fk_set_default", "SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 0 ELSE c_nationkey END AS c_nationkey FROM customer")
def fk_set_default(d: Database) -> DataFrame:
    frames, schemas = _chain(d)
    c = schemas["customer"]
    fields = tuple(Field("c_nationkey", FieldType.integer, default=0) if f.name == "c_nationkey" else f for f in c.fields)
    schemas |= {"customer": c.with_(fields=fields, foreign_keys=(_fk("c_nationkey", "nation", "n_nationkey", Action.setDefault),)), "supplier": schemas["supplier"].with_(foreign_keys=())}
    return constraints.cascade_delete(frames, schemas, "nation", frames["nation"].where("n_nationkey = 7")).frames["customer"].select("c_custkey", "c_nationkey")


q("key_sequential", "SELECT o_orderkey, 100 + 5 * (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) AS id FROM orders")(lambda d: keys.sequential(d.frame("orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], "id", 100, 5).select("o_orderkey", "id"))
_DIGITS = " || ".join(f"substr('{keys.BASE62}', CAST((n // {62**k}) % 62 AS INT) + 1, 1)" for k in range(6, -1, -1))
q("key_base62", f"SELECT o_orderkey, coalesce(nullif(ltrim({_DIGITS}, '0'), ''), '0') AS code, n AS back FROM (SELECT o_orderkey, o_orderkey * 7919 AS n FROM orders) t")(
    lambda d: d.frame("orders").select("o_orderkey", (F.col("o_orderkey") * 7919).alias("n")).select("o_orderkey", keys.base62(F.col("n")).alias("code")).withColumn("back", keys.from_base62(F.col("code")))
)
q("key_timestamp", "SELECT event_id, CAST(epoch_us(ts) // 1000 AS VARCHAR) || lpad(CAST(event_id % 1000 AS VARCHAR), 5, '0') AS k FROM events")(lambda d: d.frame("events").select("event_id", keys.timestamp_key(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 1000).cast("string").alias("k")))
q("key_date", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || '0007' || lpad(CAST(event_id % 1000 AS VARCHAR), 5, '0') AS k FROM events")(lambda d: d.frame("events").select("event_id", keys.date_key(F.col("ts"), F.col("event_id") % 1000, node=7).cast("string").alias("k")))

DAYS10 = 10 * 86_400_000
q("ttl_alive", "SELECT event_id FROM events WHERE NOT ts <= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")(lambda d: lifetime.alive_rows(d.frame("events"), "ts", DAYS10, NOW).select("event_id"))
q("ttl_expired", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")(lambda d: lifetime.expired_rows(d.frame("events"), "ts", DAYS10, NOW).select("event_id"))


def _kv(d: Database) -> DataFrame:
    """A key-value table from events: the newest event of each user and type; every third entry never ends."""
    e = d.frame("events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("id"), F.max("ts").alias("ts"))
    return e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("id").cast("string").alias("value"), F.col("ts").alias("updated_at"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("ts")).alias("expires_at"))


KV = "(SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS key, CAST(max(event_id) AS VARCHAR) AS value, CASE WHEN max(event_id) % 3 = 0 THEN NULL ELSE max(ts) END AS expires_at FROM events GROUP BY user_id, event_type)"
LIVE = f"(SELECT * FROM {KV} k WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20')"
q("kv_get_live", f"SELECT key, value FROM {LIVE} l")(lambda d: lifetime.live_pairs(_kv(d), NOW).select("key", "value"))
q("kv_keys_prefix", f"SELECT key FROM {LIVE} l WHERE starts_with(key, 'c')")(lambda d: lifetime.keys_with_prefix(_kv(d), "c", NOW))
q("kv_count_raw", f"SELECT count(*) AS n FROM {KV} k")(lambda d: _kv(d).agg(F.count(F.lit(1)).alias("n")))


@q("kv_increment", f"SELECT key, value FROM {KV} k WHERE key NOT LIKE '%:1_' UNION ALL SELECT key, CAST(CASE WHEN expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20' THEN CAST(value AS BIGINT) ELSE 0 END + 5 AS VARCHAR) FROM {KV} k WHERE key LIKE '%:1_' UNION ALL SELECT 'fresh', '5'")
def kv_increment(d: Database) -> DataFrame:
    kv = _kv(d)
    amounts = kv.where(F.col("key").like("%:1_")).select("key", F.lit(5).cast("long").alias("amount")).unionByName(d.spark.createDataFrame([("fresh", 5)], "key string, amount long"))
    return lifetime.incremented(kv, amounts, NOW).select("key", "value")


# -- schema changes, streams ---------------------------------------------------------------------------------------
@q("evolve_table", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name AS title, CAST(n_regionkey AS VARCHAR) AS n_regionkey, 'standard' AS tier FROM nation")
def evolve_table(d: Database) -> DataFrame:
    from quernel.plans.evolve import SchemaBuilder, apply_changes

    b = SchemaBuilder("nation", lambda ops: "").add_field("tier", FieldType.text, default="standard").rename_field("n_name", "title").modify_field("n_regionkey", FieldType.text)
    schema = d.schema("nation").with_(foreign_keys=())
    return apply_changes(schema, d.frame("nation"), b.ops)[1].select("n_nationkey", "title", "n_regionkey", "tier")


@q("batch_cursor", "SELECT count(*) AS n, CAST(ceil(count(*) / 400.0) AS BIGINT) AS batches FROM part")
def batch_cursor(d: Database) -> DataFrame:
    """Batches of 400 rows over the whole table, a partition at a time on the driver."""
    sizes: list[int] = []
    n = d.query_each_batch(d.query("part").select(["p_partkey"]), lambda rows: sizes.append(len(rows)), 400)
    return d.spark.createDataFrame([(n, len(sizes))], "n long, batches long")


FLAGSHIP = """
SELECT n.n_name AS nation, count(*) AS order_count, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_totalprice > 100000 AND (o.o_orderstatus = 'F' OR o.o_orderpriority = '1-URGENT')
GROUP BY n.n_name HAVING count(*) > 5 ORDER BY revenue DESC, nation LIMIT 10
"""


@q("flagship", FLAGSHIP)
def flagship(d: Database) -> DataFrame:
    """Revenue per nation of large orders that are finished or urgent."""
    b = d.query("orders").join_referenced_table("customer").join_referenced_table("nation").where("o_totalprice", ">", 100000)
    b = b.condition(Condition().where("o_orderstatus", "=", "F").or_where("o_orderpriority", "=", "1-URGENT"))
    b = b.select(["n_name as nation", Agg.count(alias="order_count"), Agg.sum("o_totalprice", "revenue")]).group_by(["n_name"]).having(Condition().where("order_count", ">", 5))
    return b.order_by_desc("revenue").order_by_asc("nation").limit(10).df().select("nation", "order_count", r2("revenue"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(database(spark, sf_dir))) for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
