"""The shared folder, and what is left in it."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from netloom import session
from netloom.plans import ordering, skew


def test_a_cluster_must_name_the_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))


def test_copies_can_be_deleted(spark):
    copy = session.materialize(spark.range(10))
    path = copy._netloom_path.removeprefix("file://")
    assert copy.count() == 10 and os.path.isdir(path)
    session.discard(copy, spark.range(3))
    assert not os.path.exists(path)


def test_levels_are_read_as_one(spark):
    levels = session.Levels(spark, "k")
    for k in range(4):
        levels.write(spark.range(k).withColumn("x", F.lit("a")), k)
    assert sorted((r["id"], r["k"]) for r in levels.read().collect()) == sorted((i, k) for k in range(4) for i in range(k))


def test_ranks_and_positions(spark):
    rows = [(g, (g * 31 + i * 17) % 101) for g in range(5) for i in range(g * 20)]
    df = spark.createDataFrame(rows, "graph_id long, v long").repartition(7)
    want = sorted((g, v, r) for g in range(5) for r, v in enumerate(sorted(v for h, v in rows if h == g)))
    assert sorted(map(tuple, ordering.with_rank(df, "v").select("graph_id", "v", "rank").collect())) == want
    assert [r["p"] for r in ordering.with_position(df, "v", "graph_id", out="p").orderBy("v", "graph_id").collect()] == list(range(len(rows)))


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW_ROWS", 10)
    many = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    one = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    hot = skew.hot_keys(many.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")
    assert [len(v) for v in hot.values()] == [1] and min(hot) > 1
    joined = skew.spread_join(many, one, "k", hot, "x")
    assert joined.count() == 3000 and joined.where("k = 7 and y = 14").count() == 2000
