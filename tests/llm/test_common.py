from types import SimpleNamespace

import pytest

from spindrift.llm import common as c
from pyspark.sql import functions as F


def session(**settings):
    settings = {k.replace("_", "."): v for k, v in settings.items()}
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda key, default=None: settings.get(key, default))))


def test_shared_folder(monkeypatch, tmp_path):
    monkeypatch.setattr(c.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    assert c.shared_dir(session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    for master in ("local", "local[*]", "local[4]"):
        assert c.shared_dir(session(spark_master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://x", ""):
        with pytest.raises(RuntimeError):
            c.shared_dir(session(spark_master=master))


def test_scratch_deletes_what_was_written_inside(spark):
    before = len(c._written)
    outer = c.materialise(spark.range(5).toDF("x"), "outer")
    with c.scratch():
        inner = c.materialise(spark.range(7).toDF("x"), "inner", 7)
        assert inner.count() == 7 and len(c._written) == before + 2
    assert outer.count() == 5 and len(c._written) == before + 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(inner.inputFiles()[0]).count()


def test_hot_keys_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(c, "HOT", 10)
    rows = spark.range(1000).select(F.col("id").alias("x"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), F.lit(1).alias("hot_key"))
    sums = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    got = c.join_sums(rows, sums, ["k"], "n", 1000)
    assert sorted(got.columns) == ["hot_key", "k", "n", "s", "x"]
    assert sorted(map(tuple, got.select("x", "k", "n", "s").collect())) == sorted(map(tuple, rows.join(sums, "k").select("x", "k", "n", "s").collect()))
    assert c.join_sums(rows.limit(0), sums.limit(0), ["k"], "n", 0).count() == 0
