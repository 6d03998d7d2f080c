"""Running values: the chunked path equals the plain window, on any partitioning."""

import random
from collections import Counter

from pyspark.sql import functions as F

from runframe import scan
from runframe.operators.scan import has_hot_group, largest_group, weighted_sample

def specs():
    x, y = F.col("x"), F.col("y")
    return {"n": ("row_number",), "s": ("sum", x), "b": ("sum_before", x), "m": ("max_before", x), "l": ("lag", x),
            "k": ("last_before", y), "t": ("total", x)}


def rows(seed, n=400):
    rng = random.Random(seed)
    keys = ["a"] * 6 + ["b", "c", None]  # one key holds most rows, one is null
    return [(rng.choice(keys), i, rng.randrange(100), rng.choice([None, rng.randrange(9)])) for i in range(n)]


def results(df, by, hot):
    return sorted((tuple(r) for r in scan(df, by, ["at"], specs(), hot).collect()), key=repr)


def test_chunked_equals_plain(hot):
    for seed in (1, 2):
        df = hot.createDataFrame(rows(seed), "g string, at long, x long, y long")
        for by in (["g"], []):
            plain = results(df, by, False)
            assert results(df, by, True) == plain
            assert results(df.repartition(7, "x"), by, True) == plain


def test_descending_order(hot):
    df = hot.createDataFrame(rows(3), "g string, at long, x long, y long")
    spec = {"n": ("row_number",), "l": ("lag", F.col("at"))}
    got = [sorted(map(tuple, scan(df, "g", ["-at"], spec, h).collect()), key=repr) for h in (True, False)]
    assert got[0] == got[1]


def test_types_and_directions_of_the_order(hot):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", None]), rng.choice([None, "x", "y", "z"]), i, rng.choice([None, float(i % 7)])) for i in range(300)]
    df = hot.createDataFrame(data, "g string, s string, at long, x double").withColumn("day", F.expr("timestamp_seconds(at div 9)"))
    for order in (["s", "-at"], ["-s", "at"], ["-day", "s", "at"], ["-at"]):
        got = [sorted((tuple(r) for r in scan(df, "g", order, {
            "n": ("row_number",), "l": ("lag", F.col("s")), "k": ("last_before", F.col("x")), "b": ("sum_before", F.col("x"))}, h).collect()), key=repr)
            for h in (None, False)]
        assert got[0] == got[1]


def test_a_small_file_that_explodes_to_one_group(spark, tmp_path):
    """The hot group appears after the read, so no size of a file or a plan shows it; its chunks go to several tasks."""
    spark.range(4).withColumn("n", F.lit(5000)).coalesce(1).write.parquet(str(tmp_path / "t"))
    grown = (spark.read.parquet(str(tmp_path / "t")).withColumn("k", F.expr("explode(sequence(1, n))"))
             .selectExpr("if(k % 10 = 0, 'b', 'a') AS g", "id * 5000 + k AS at", "k % 7 AS x"))
    spark.conf.set("spark.runframe.hotGroupRows", "2000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert has_hot_group(grown, "g", 10_000) and not has_hot_group(grown, "g", 40_000)
        total, most = largest_group(grown, "g")
        assert abs(total - 20_000) < 4_000 and abs(most - 18_000) < 4_000
        out = scan(grown, "g", "at", {"s": ("sum", F.col("x")), "l": ("lag", F.col("at"))}).withColumn("task", F.spark_partition_id())
        rows = out.collect()
        tasks = Counter(r["task"] for r in rows if r["g"] == "a")
        assert len(tasks) >= 3 and max(tasks.values()) < 12_000
        assert sorted(tuple(r)[:-1] for r in rows) == sorted(map(tuple, scan(
            grown, "g", "at", {"s": ("sum", F.col("x")), "l": ("lag", F.col("at"))}, False).collect()))
    finally:
        spark.conf.unset("spark.runframe.hotGroupRows")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_the_sample_stands_for_all_rows(spark):
    df = spark.range(0, 200_000, 1, 3).withColumn("g", F.col("id") % 3)
    sample = weighted_sample(df, ["g"])
    n, w = sample.agg(F.count("*"), F.sum("_w")).first()
    assert n < 3 * 3000 and abs(w - 200_000) < 30_000
    total, most = largest_group(df, "g")
    assert abs(most - 66_667) < 15_000
    assert largest_group(df.limit(0), "g") == (0.0, 0.0) and scan(df.limit(0), "g", "id", {"n": ("row_number",)}).count() == 0
