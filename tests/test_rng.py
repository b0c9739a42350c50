import duckdb
from pyspark.sql import functions as F

from netloom.functions.rng import Rng, uniform, uniform_py, uniform_sql


def test_three_engines_agree(spark):
    rows = spark.range(500).select("id", uniform(42, "t", "id", 7).alias("u")).collect()
    sql = dict(duckdb.sql(f"SELECT i, {uniform_sql(42, 't', 'i', '7')} FROM range(500) r(i)").fetchall())
    for r in rows:
        assert r["u"] == sql[r["id"]] == uniform_py(42, "t", r["id"], 7)


def test_uniformity_by_chi_square(spark):
    n, bins = 20_000, 50
    counts = spark.range(n).select(F.floor(uniform(1, "chi", "id") * bins).alias("b")).groupBy("b").count().collect()
    assert sum((r["count"] - n / bins) ** 2 / (n / bins) for r in counts) < 85.4  # 99.9 % point of chi-square with 49 degrees


def test_state_is_the_counter():
    a = Rng(5, "s")
    first = [a.random() for _ in range(10)]
    b = Rng(5, "s", counter=4)
    assert [b.random() for _ in range(6)] == first[4:]


def test_pairs_differ_and_stay_in_range():
    r = Rng(1, "p")
    seen = {r.pair(3) for _ in range(500)}
    assert seen == {(a, b) for a in range(3) for b in range(3) if a != b}
