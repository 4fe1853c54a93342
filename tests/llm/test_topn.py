"""Top N of every group, against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from throng.llm import topn


def brute(rows, n):
    by = defaultdict(list)
    for g, s, t in rows:
        if g and s is not None and t is not None:
            by[g].append((-s, t))
    return sorted((g, i, t, -s) for g, v in by.items() for i, (s, t) in enumerate(sorted(v)[:n], 1))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [("hot", rnd.randint(0, 50), f"t{i}") for i in range(6000)] + [(f"g{i % 700}", rnd.randint(0, 3), f"t{i}") for i in range(3000)]
    rows += [(None, 9, "t"), ("", 9, "t"), ("g1", None, "t"), ("g1", 99, None), ("été", 5, "ü"), ("z" * 300, -7, "t")]
    df = spark.createDataFrame(rows, "grp string, score long, tie string").repartition(5)
    for n in (1, 3):
        got = sorted(map(tuple, topn.top_n_by_group(df, "grp", "score", "tie", n, files=6, row_group_bytes=4096).collect()))
        assert got == brute(rows, n)


def test_all_scores_equal_and_repeated_rows(spark):
    rows = [("g", 1, "a")] * 4 + [("g", 1, "b")]
    got = sorted(map(tuple, topn.top_n_by_group(spark.createDataFrame(rows, "grp string, score long, tie string"), "grp", "score", "tie").collect()))
    assert got == [("g", 1, "a", 1), ("g", 2, "a", 1), ("g", 3, "a", 1)]


def test_a_large_group_is_mostly_skipped(spark):
    """One author of a million rows and 20,000 of one to three."""
    hot = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("s"), F.concat(F.lit("t"), "id").alias("t"))
    rest = spark.range(40_000).select(F.concat(F.lit("a"), F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("g"), (F.col("id") % 7).alias("s"), F.concat(F.lit("t"), "id").alias("t"))
    df = hot.unionByName(rest)
    r = topn.row_groups_read(df, "g", "s", "t", files=4).first()
    assert r.row_groups == r.proved + r.passed + r.read and r.row_groups > 120
    assert r.proved + r.passed > 110 and r.read < 15
    got = sorted(map(tuple, topn.top_n_by_group(df, "g", "s", "t", files=4).where("g = 'hot'").collect()))
    assert got == sorted((x.g, i, x.t, x.s) for i, x in enumerate(hot.orderBy(F.desc("s"), "t").limit(3).collect(), 1))


def test_equal_scores_are_never_skipped(spark):
    """Row groups at, not below, the proof may hold the smaller ties."""
    df = spark.range(5000).select(F.lit("g").alias("g"), F.lit(1).alias("s"), F.lpad((5000 - F.col("id")).cast("string"), 4, "0").alias("t"))
    assert topn.row_groups_read(df, "g", "s", "t", files=3, row_group_rows=100).first()["read"] >= 50
    assert [r.t for r in topn.top_n_by_group(df, "g", "s", "t", files=3, row_group_rows=100).orderBy("place").collect()] == ["0001", "0002", "0003"]


def test_skipping_while_a_file_is_read(spark):
    """Row groups of fewer than n rows prove nothing, but what was read does."""
    df = spark.range(2000).select(F.lit("g").alias("g"), F.col("id").alias("s"), F.col("id").cast("string").alias("t"))
    r = topn.row_groups_read(df, "g", "s", "t", n=150, files=1, row_group_rows=100).first()
    assert (r.proved, r.read) == (0, 2) and r.passed == r.row_groups - 2
    assert sorted(x.s for x in topn.top_n_by_group(df, "g", "s", "t", n=150, files=1, row_group_rows=100).collect()) == list(range(1850, 2000))


def test_very_long_groups(spark):
    rows = [("y" * 9000 + str(i % 3), i, f"t{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "grp string, score long, tie string")
    assert sorted(map(tuple, topn.top_n_by_group(df, "grp", "score", "tie", 2, files=2, row_group_rows=100).collect())) == brute(rows, 2)


def test_latest_row_counts(spark):
    rows = [("c0", "@a", 9, 1, "x"), ("c0", "@a", 2, 2, "x"), ("c1", "@a", None, 5, "x"), ("c1", "@a", 7, 4, "x"), ("c2", "@a", 3, None, "x"), ("c3", "", 3, 1, "x"), ("c4", None, 3, 1, "x"), (None, "@a", 3, 1, "x")]
    df = spark.createDataFrame(rows, "cid string, author string, likes long, loaded_at long, place string")
    assert sorted(map(tuple, topn.found(df).collect())) == [("@a", 1, "c2"), ("@a", 2, "c0")]
    assert topn.found(df.limit(0)).count() == 0
