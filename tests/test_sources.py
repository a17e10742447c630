"""Readers, sinks and the stream of draw batches."""

import pytest
from pyspark.sql import functions as F

from gridpanel.session import checkpoint_dir, cut_lineage
from gridpanel.sources import readers, sinks
from gridpanel.streaming import progress


def test_mapping_with_quoted_comma(spark, tmp_path):
    (tmp_path / "map.csv").write_text('code,label\n426,"a ""b"""\n427,"Sparse, mixed cover"\n428,\n')
    got = {r["code"]: r["label"] for r in readers.read_mapping(spark, str(tmp_path / "map.csv"), "code int, label string").collect()}
    assert got[427] == "Sparse, mixed cover" and got[428] is None and got[426] == 'a "b"'


def test_flagged_tsv(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("unit,geo\\TIME_PERIOD\t2019 \t2020\nHD,AT\t12.5 e\t:\nHD, BE\t: c\t7\n")
    got = {(r["geo"], r["year"]): r["value"] for r in readers.read_flagged_tsv(spark, str(tmp_path / "x.tsv")).collect()}
    assert got == {("AT", 2019): 12.5, ("AT", 2020): None, ("BE", 2019): None, ("BE", 2020): 7.0}


def test_projected_scan_prunes_columns(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(5).select("id", F.lit(1.0).alias("Pop_2010"), F.lit(2.0).alias("Pop_2020"), F.lit("x").alias("junk")).write.parquet(path)
    df = readers.scan(spark, path, ["id"], [r"^Pop_\d{4}$"], {"id": "cell"})
    assert df.columns == ["cell", "Pop_2010", "Pop_2020"]
    assert "junk" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        readers.scan(spark, path, ["absent"])


def test_registry(spark, tmp_path):
    path = str(tmp_path / "lum")
    spark.createDataFrame([(1, 5, 2.0), (2, 5, 0.0)], "id int, lu int, km2 double").write.parquet(path)
    reg = readers.SourceRegistry({("maps", 2018): readers.SourceEntry(path, "id", "lu", "km2"), ("maps", 2000): readers.SourceEntry(path, "id", "zz", "km2")})
    assert [tuple(r) for r in reg.load(spark, "maps", 2018).collect()] == [(1, 5, 2.0)]
    with pytest.raises(KeyError):
        reg.load(spark, "maps", 1990)
    with pytest.raises(ValueError):
        reg.load(spark, "maps", 2000)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2000, 1.5), (2, 2010, 2.5)], "id int, year int, v double")
    sinks.write_with_metadata(df, str(tmp_path / "t"), {"seed": 7}, partition_by=["year"])
    assert sinks.read_metadata(spark, str(tmp_path / "t")) == {"columns": ["id", "year", "v"], "seed": 7}
    assert spark.read.parquet(str(tmp_path / "t/data")).where("year = 2010").count() == 1
    sinks.write_table(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "d"), fmt="tiff")


def test_draw_folder_and_stream(spark, tmp_path):
    path = str(tmp_path / "draws")
    base = spark.range(40).select(
        (F.col("id") % 2).alias("chain"), F.floor(F.col("id") / 20).alias("batch"), (F.floor(F.col("id") / 2) + 1).alias("iter"),
        F.lit("a").alias("param"), (F.col("id") * 0.5).alias("value"),
    )
    sinks.write_table(base, path, partition_by=["chain", "batch"])
    assert readers.read_draws(spark, path).count() == 40
    assert readers.read_draws(spark, path, chains=[1]).select("chain").distinct().count() == 1
    flat = str(tmp_path / "flat")
    base.write.parquet(flat)
    stream = progress.watch_draws(spark, flat, base.schema)
    q = progress.upsert_running_stats(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    last = spark.read.parquet(str(tmp_path / "out"))
    newest = last.groupBy("chain", "param").agg(F.max_by("n", "batch").alias("n"), F.max_by("mean", "batch").alias("mean"))
    want = {(r["chain"], r["n"], r["mean"]) for r in progress.running_stats(base).collect()}
    assert {(r["chain"], r["n"], r["mean"]) for r in newest.collect()} == want


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert cut_lineage(spark.range(3)).count() == 3
