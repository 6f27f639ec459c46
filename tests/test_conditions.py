import random

import pytest
from pyspark.sql import functions as F

from quernel.functions import expr as X
from quernel.operators.write import resolver
from quernel.plans.condition import Condition

ROWS = [(i, None if i % 5 == 0 else "abc"[i % 3] * (i % 4) + ("\n" if i % 7 == 0 else "") + ("\\" if i % 11 == 0 else ""), None if i % 6 == 0 else (i * 37 % 50) / 4) for i in range(60)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "k long, s string, x double").cache()


def keys(frame, c):
    return {r.k for r in frame.where(c.to_column(resolver(frame))).select("k").collect()}


def twin(frame, c):
    kinds = {f.name: f.dataType for f in frame.schema}
    return {r[0] for r in ROWS if c.matches(dict(zip("ksx", r, strict=True)), kinds)}


def test_random_conditions_match_their_twin(frame):
    rng = random.Random(3)

    def some(depth=0):
        c = Condition()
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.4:
                c.or_()
            if depth < 2 and rng.random() < 0.3:
                c.condition(some(depth + 1))
                continue
            name = rng.choice("ksx")
            value = rng.choice(["a", "bb", "", "c%"]) if name == "s" else rng.choice([0, 3, 7.5, "6", "12"])
            op = rng.choice(["=", "!=", ">", "<=", "IN", "NOT IN", "BETWEEN", "IS", "IS NOT", "LIKE", "NOT LIKE"])
            if op in ("IN", "NOT IN"):
                value = [value, rng.choice([1, 2, "b"]) if name != "s" else "b"]
            elif op == "BETWEEN":
                value = [value, "c" if name == "s" else 20]
            elif op in ("IS", "IS NOT"):
                value = None
            elif "LIKE" in op:
                value = rng.choice(["%a%", "a_", "%", "b%", "%\\", "_\n", "1%"])
            c.where(name, op, value)
        return c

    for _ in range(60):
        c = some()
        assert keys(frame, c) == twin(frame, c), c.build()
        assert keys(frame, Condition.from_map(c.build())) == keys(frame, c)


def test_null_rules(frame):
    nulls = {r[0] for r in ROWS if r[1] is None}
    assert nulls <= keys(frame, Condition().where("s", "!=", "a"))
    assert nulls <= keys(frame, Condition().where_not_in("s", ["a"]))
    assert not nulls & keys(frame, Condition().where_not_like("s", "a%"))
    assert keys(frame, Condition().where_empty("s")) == nulls | {r[0] for r in ROWS if r[1] == ""}


def test_like_has_no_escape_and_matches_line_breaks(frame):
    assert keys(frame, Condition().where_ends_with("s", "\\")) == {r[0] for r in ROWS if r[1] and r[1].endswith("\\")}
    assert keys(frame, Condition().where_like("s", "%_")) == {r[0] for r in ROWS if r[1]}


def test_bad_conditions():
    for bad in (lambda: Condition().where("a", "~", 1), lambda: Condition().where("a", "=", None), lambda: Condition().where("a", "IS", 3), lambda: Condition().where("a", "BETWEEN", [1])):
        with pytest.raises(ValueError):
            bad()


def test_expressions(spark):
    f = spark.createDataFrame([(7, None, "12"), (-7, 3, "x")], "a long, b long, s string")
    row = lambda e: [r[0] for r in f.orderBy(F.col("a").desc()).select(X.compile_expr(e, resolver(f))).collect()]
    a, b, s = map(X.field, "abs")
    assert row(a / b) == [0, -7 / 3]
    assert row(a % 3) == [1, 2]
    assert row(a + b) == [7, -4]
    assert row(s + 1) == [13, 1]
    assert row(X.rounded(a * 0.5)) == [4, -4]
    assert row(X.if_else(b, 1, 2)) == [2, 1]
    assert row(X.least(a, b)) == [0, -7]
