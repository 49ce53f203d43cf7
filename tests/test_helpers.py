"""Range joins, ordinals and hot keys against brute force; results must not depend on tuning."""

import random

import pytest
from pyspark.sql import functions as F

from formloom.operators.islands import number_chains, number_interval_islands
from formloom.operators.grouped import map_groups
from formloom.operators.ordinals import running_total
from formloom.operators.ranges import first_hit, overlapping_pairs
from formloom.operators.sizing import fits_broadcast, hot_safe_join

rnd = random.Random(7)
RECTS = [(i, rnd.randrange(0, 300), rnd.randrange(0, 300), rnd.randrange(1, 120), rnd.randrange(1, 120)) for i in range(40)]
POINTS = [(k, rnd.randrange(0, 800) / 2, rnd.randrange(0, 800) / 2) for k in range(400)]


def brute_hit(x, y):
    for i, rx, ry, w, h in RECTS:
        if rx <= x < rx + w and ry <= y < ry + h:
            return i
    return None


@pytest.mark.parametrize("bucket,limit", [(128, None), (7, None), (500, None), (64, 0)])
def test_first_hit_is_the_first_containing_rect(spark, bucket, limit):
    points = spark.createDataFrame([("t", *p) for p in POINTS], "t STRING, id INT, x DOUBLE, y DOUBLE")
    rects = spark.createDataFrame([("t", *r) for r in RECTS], "t STRING, priority INT, x INT, y INT, w INT, h INT")
    rects = rects.withColumn("name", F.col("priority"))
    odd = ("odd", lambda c: c["name"] % 2 == 1)
    out = first_hit(points, rects, ["t"], ["name"], bucket=bucket, broadcast_rows=limit, salts=3, also=odd)
    got = {r["id"]: (r["hit"] and r["hit"]["name"], r["odd"] and r["odd"]["name"]) for r in out.collect()}
    assert len(got) == len(POINTS)
    for k, x, y in POINTS:
        all_hits = [i for i, rx, ry, w, h in RECTS if rx <= x < rx + w and ry <= y < ry + h]
        odds = [i for i in all_hits if i % 2]
        assert got[k] == (all_hits[0] if all_hits else None, odds[0] if odds else None)


@pytest.mark.parametrize("hot", [1, 10**6])
def test_first_hit_keeps_equal_points_on_both_paths(spark, hot):
    points = spark.createDataFrame([("t", p[1], p[2]) for p in POINTS for _ in range(1 + p[0] % 3)], "t STRING, x DOUBLE, y DOUBLE")
    rects = spark.createDataFrame([("t", *r) for r in RECTS], "t STRING, priority INT, x INT, y INT, w INT, h INT")
    both = [
        sorted(((r["x"], r["y"], r["hit"] and r["hit"]["priority"]) for r in out.collect()), key=repr)
        for out in (first_hit(points, rects, ["t"], []), first_hit(points, rects, ["t"], [], broadcast_rows=0, hot_rows=hot, salts=3))
    ]
    assert len(both[0]) == points.count()
    assert repr(both[0]) == repr(both[1])


@pytest.mark.parametrize("bucket,limit,hot", [(128, 200_000, 1_000_000), (16, 200_000, 1), (64, 0, 1), (64, 0, 10**6)])
def test_overlapping_pairs(spark, bucket, limit, hot):
    rects = spark.createDataFrame([("t", *r) for r in RECTS], "t STRING, id INT, x INT, y INT, w INT, h INT")
    out = overlapping_pairs(rects, ["t"], "id", [], bucket=bucket, hot_rows=hot, salts=3, broadcast_rows=limit)
    got = sorted((r["a"]["id"], r["b"]["id"]) for r in out.collect())
    want = sorted(
        (a[0], b[0]) for a in RECTS for b in RECTS
        if a[0] < b[0] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]
    )
    assert got == want


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_running_total_with_a_hot_key(spark, partitions):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "k STRING, ord INT, v LONG").repartition(5)
    out = running_total(df, ["ord"], "v", "total", keys=["k"], partitions=partitions)
    sums, want = {}, {}
    for k, o, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[k, o] = sums[k]
    assert {(r["k"], r["ord"]): r["total"] for r in out.collect()} == want


def test_running_total_without_keys(spark):
    df = spark.range(100).select(F.col("id").alias("ord"), F.lit(1).cast("long").alias("v"))
    assert all(r["t"] == r["ord"] + 1 for r in running_total(df, ["ord"], "v", "t", partitions=6).collect())


@pytest.mark.parametrize("hot", [1, 10, 10**6])
def test_hot_safe_join_keeps_every_row(spark, hot):
    big = spark.createDataFrame([("a" if i % 3 else f"b{i}", i) for i in range(300)], "k STRING, i INT")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("m"))
    out = hot_safe_join(big, small, ["k"], "n", ["i"], hot_rows=hot, salts=4)
    rows = out.collect()
    assert sorted(r["i"] for r in rows) == list(range(300))
    assert all(r["m"] == (1 if r["k"] == "a" else r["i"]) for r in rows)


def test_fits_broadcast(spark):
    assert fits_broadcast(spark.range(10), 10)
    assert not fits_broadcast(spark.range(11), 10)


def test_islands(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 3, 9, 10, 20)], "k STRING, v INT")
    assert [r["g"] for r in number_chains(df, ["k"], "v", 5, "g").orderBy("v").collect()] == [0, 0, 1, 1, 2]
    runs = spark.createDataFrame([("a", 0, 50), ("a", 10, 12), ("a", 51, 60), ("a", 70, 71)], "k STRING, s INT, e INT")
    got = number_interval_islands(runs, ["k"], "s", "e", 5, "g").orderBy("s").collect()
    assert [r["g"] for r in got] == [0, 0, 0, 1]


def test_groups_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i % 5, i) for i in range(200)], "k INT, v INT")
        out = map_groups(df, ["k"], ["v"], lambda key, rows: [(key[0], len(rows["v"]), rows["v"] == sorted(rows["v"]))],
                         "k INT, n INT, ok BOOLEAN").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["k"], r["n"], r["ok"]) for r in out) == [(k, 40, True) for k in range(5)]
