import random

from pyspark.sql import functions as F

from loomfield.operators import substring


def test_holding_against_every_pair(spark):
    rnd = random.Random(3)
    word = lambda a, b: "".join(rnd.choice("abAé𝒳.") for _ in range(rnd.randint(a, b)))
    texts = [word(0, 30) for _ in range(150)] + ["ab" * 9000 + "é.", "", "a", None] + ["hot host"] * 50
    needles = [word(1, 6) for _ in range(120)] + ["", None, "a", "b", "ab", "aba", "hot host", "hot host and more", "bé." , "zzz"]
    got = substring.holding(spark.createDataFrame([(t,) for t in texts], "x string"), spark.createDataFrame([(n,) for n in needles * 2], "y string"))
    want = {(t, n) for t in texts if t is not None for n in needles if n and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_matches_in_any_column_and_case(spark):
    rows = spark.createDataFrame([(1, "Red BOLT", None), (1, "red bolt", "x"), (2, "É", "steel,Bolt"), (3, None, None), (None, "bolt", "")], "id long, a string, b string")
    needles = spark.createDataFrame([("bolt",), ("BOLT",), ("é",), ("",), (None,)], "n string")
    got = {tuple(r) for r in substring.matches(rows, "id", ["a", "b"], needles, ignore_case=True).collect()}
    assert got == {(i, n) for i in (1, 2, None) for n in ("bolt", "BOLT")}  # É isn't ASCII
    assert {tuple(r) for r in substring.matches(rows, "id", ["a", "b"], needles).collect()} == {(1, "bolt"), (1, "BOLT"), (None, "bolt")}


def test_nothing_to_look_for(spark):
    none = spark.createDataFrame([], "n string")
    some = spark.createDataFrame([("abc",)], "n string")
    assert substring.holding(some, none).collect() == substring.holding(none, some).collect() == substring.holding(none, none).collect() == []


def test_no_pair_is_made_by_a_nested_loop(spark):
    plan = substring.holding(spark.range(9).select(F.col("id").cast("string")), spark.range(5).select(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
