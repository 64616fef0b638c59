import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrank.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value holds a third of it."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        group = None if i % 50 == 0 else ("hot" if i % 4 else "cold")
        value = 1.0 if i % 3 == 0 else float(np.round(rng.normal(), 3))
        rows.append((group, i, value))
    return spark.createDataFrame(rows, "g string, position bigint, value double"), rows


@pytest.fixture(params=[(65_536, 1_024), (7, 64), (1, 1_024), (50, 4)], autouse=True)
def buckets(request, monkeypatch):
    """Results are the same from one bucket for a group to one for every row."""
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", request.param[0])
    monkeypatch.setattr(ranking, "GRID", request.param[1])
    return request.param


def test_buckets_are_even_and_in_order(skewed, buckets):
    df, rows = skewed
    distinct = df.select("g", "value").distinct()
    got = ranking._value_buckets(distinct, ["g"], "value").groupBy("g", "__bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    ).collect()
    for group in {r[0] for r in rows}:
        own = sorted((r for r in got if r["g"] == group), key=lambda r: r["__bucket"])
        n = len({v for g, _, v in rows if g == group})
        assert sum(r["n"] for r in own) == n
        assert all(a["high"] < b["low"] for a, b in zip(own, own[1:], strict=False))
        wanted = min(-(-n // buckets[0]), buckets[1])
        assert len(own) <= wanted and max(r["n"] for r in own) <= 2 * n / wanted + 2


def test_no_job_runs_before_the_result(spark, skewed):
    df, _ = skewed
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "")
    ranking.value_rank(df, ["g"], "value", "position")
    assert not seen.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hashed_rank_is_row_number(spark, skewed):
    df, rows = skewed
    hashed = df.withColumn("h", F.sha2(F.col("position").cast("string"), 256))
    got = ranking.hashed_rank(hashed, ["g"], "h").collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], []).append((r["h"], r["rank"], r["group_size"]))
    assert sum(len(v) for v in by_group.values()) == len(rows)
    for members in by_group.values():
        assert [m[1] for m in sorted(members)] == list(range(1, len(members) + 1))
        assert {m[2] for m in members} == {len(members)}


def test_value_rank_orders_ties_by_position(skewed):
    df, rows = skewed
    got = {r["position"]: r["rank"] for r in ranking.value_rank(df, ["g"], "value", "position").collect()}
    for group in {r[0] for r in rows}:
        members = sorted((v, p) for g, p, v in rows if g == group)
        assert [got[p] for _, p in members] == list(range(len(members)))


def test_quantiles_match_linear_interpolation(skewed):
    df, rows = skewed
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r["g"], r["probability"]): r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "value", probabilities).collect()}
    for group in {r[0] for r in rows}:
        values = [v for g, _, v in rows if g == group]
        for p in probabilities:
            assert got[(group, p)] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quartile_buckets_are_not_ntile(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(6)], "g string, position bigint, value double")
    ranked = ranking.value_rank(df, ["g"], "value", "position")
    sizes = ranked.groupBy(F.floor(F.col("rank") * 4 / F.col("total")).alias("b")).count().orderBy("b").collect()
    assert [r["count"] for r in sizes] == [2, 1, 2, 1]
