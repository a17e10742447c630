"""Skew-safe plan shapes against brute force, with one key holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpanel.plans import skew


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(3000) < 0.34, "hot", rng.integers(0, 40, 3000).astype(str))
    values = np.where(rng.random(3000) < 0.3, 1.5, np.round(rng.normal(size=3000), 2))  # one value is hot too
    pdf = pd.DataFrame({"id": np.arange(3000), "k": keys, "v": values})
    return spark.createDataFrame(pdf), pdf


def test_quantiles_match_numpy(table):
    df, pdf = table
    probs = {"a": 0.025, "b": 0.5, "c": 0.9}
    for bounded in (False, True):
        got = skew.group_quantiles(df, ["k"], "v", probs, bounded).toPandas().set_index("k")
        for k, part in pdf.groupby("k"):
            assert np.allclose(got.loc[k, list(probs)].astype(float), np.quantile(part["v"], list(probs.values())))
    overall = skew.group_quantiles(df, [], "v", probs).first()
    assert np.allclose([overall[n] for n in probs], np.quantile(pdf["v"], list(probs.values())))


def test_average_ranks_match_pandas(table):
    df, pdf = table
    got = skew.average_ranks(df, ["k"], "v").toPandas().sort_values("id")
    assert np.allclose(got["rank"], pdf.groupby("k")["v"].rank().to_numpy())
    assert (got["rank_n"].to_numpy() == pdf.groupby("k")["v"].transform("size").to_numpy()).all()


def test_dense_index_and_running_total(table):
    df, pdf = table
    got = skew.dense_index(df, ["k"], "id", "n", width=100).toPandas().sort_values("id")
    assert (got["n"].to_numpy() == pdf.groupby("k").cumcount().to_numpy() + 1).all()


def test_group_values_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 3.0)], "k string, v double")
    got = {(r["k"], r["v"]): r["t"] for r in skew.with_group_values(df, ["k"], t=F.sum("v")).collect()}
    assert got == {("a", 1.0): 1.0, (None, 2.0): 5.0, (None, 3.0): 5.0}


def test_take_by_hash_is_exact_and_reproducible(table):
    df, _ = table
    first = skew.take_by_hash(df, ["k"], ["id"], F.floor(F.col("n") * 0.3), 5, "t")
    counts = {r["k"]: (r["n"], r["t"]) for r in first.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("t").cast("int")).alias("t")).collect()}
    assert all(t == int(n * 0.3 + 1e-9) for n, t in counts.values())
    again = skew.take_by_hash(df.repartition(7), ["k"], ["id"], F.floor(F.col("n") * 0.3), 5, "t")
    assert {r[0] for r in first.where("t").select("id").collect()} == {r[0] for r in again.where("t").select("id").collect()}


def test_salted_join_equals_join(table, spark):
    df, _ = table
    side = spark.createDataFrame([("hot", i) for i in range(5)] + [("1", 9)], "k string, w int")
    a = sorted(tuple(r) for r in skew.salted_join(df, side, ["k"], 4).select("id", "w").collect())
    assert a == sorted(tuple(r) for r in df.join(side, "k").select("id", "w").collect())


def test_a_hot_key_is_cut_into_many_ranges(table):
    counts = skew.value_counts(table[0].withColumn("v", F.col("v") + F.col("id") / 1e6), ["k"], "v")
    rows = skew.range_bucketed(counts.repartition(3), ["k"], ["_v"]).orderBy("k", "_v").collect()
    hot = [r["_b"] for r in rows if r["k"] == "hot"]
    assert hot == sorted(hot) and len(rows) == counts.count() == 3000
    with_conf = table[0].sparkSession
    with_conf.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = skew.range_bucketed(counts, ["k"], ["_v"]).where("k = 'hot'").groupBy("_b").count().collect()
    finally:
        with_conf.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 0.8 * len(hot)


def test_quantiles_and_ranks_over_many_ranges(table, spark):
    df, pdf = table
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = skew.group_quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.77}).toPandas().set_index("k")
        ranks = skew.average_ranks(df, ["k"], "v").toPandas().sort_values("id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, part in pdf.groupby("k"):
        assert np.allclose(got.loc[k, ["a", "b"]].astype(float), np.quantile(part["v"], [0.01, 0.77]))
    assert np.allclose(ranks["rank"], pdf.groupby("k")["v"].rank().to_numpy())


def test_ranks_without_keys(table):
    df, pdf = table
    got = skew.average_ranks(df, [], "v").toPandas().sort_values("id")
    assert np.allclose(got["rank"], pdf["v"].rank().to_numpy()) and "_all_rows" not in got.columns


@pytest.mark.parametrize(("ordered", "bits"), [(50_000, 12), (20, 4), (3, 1)])
def test_selection_orders_only_the_rows_at_the_quota(spark, monkeypatch, ordered, bits):
    monkeypatch.setattr(skew, "ORDERED_ROWS", ordered)
    monkeypatch.setattr(skew, "DIGIT_BITS", bits)
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i % 7}") for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, k string")
    hashed = {r["id"]: r["h"] for r in df.select("id", skew.hash_order(5, "id").alias("h")).collect()}
    for keys, quota in ((["k"], F.col("n") * 0.25), ([], F.lit(100)), ([], F.lit(5000)), (["k"], F.lit(0)), ([], F.lit(None).cast("int"))):
        out = skew.take_by_hash(df, keys, ["id"], quota, 5, "took")
        assert out.columns == ["id", "k", "took"]
        got = {r["id"]: r["took"] for r in out.collect()}
        assert len(got) == 1200 and out.count() == 1200
        groups = {}
        for i, k in rows:
            groups.setdefault(k if keys else "all", []).append(i)
        for members in groups.values():
            n = {"n": len(members)}
            many = len(members) // 4 if quota is not None and "n" in str(quota) and keys and "* 0.25" in str(quota) else None
            taken = sum(got[i] for i in members)
            first = sorted(members, key=lambda i: (hashed[i], i))
            assert all(got[i] for i in first[:taken]) and not any(got[i] for i in first[taken:])
            if many is not None:
                assert taken == many == int(n["n"] * 0.25)
    assert sum(r["took"] for r in skew.take_by_hash(df, [], ["id"], F.lit(100), 5, "took").collect()) == 100
    assert sum(r["took"] for r in skew.take_by_hash(df, [], ["id"], F.lit(5000), 5, "took").collect()) == 1200
