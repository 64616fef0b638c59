import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrank.functions import vectors
from orbitrank.operators import metrics, multilabel, slices

STORE = "position bigint, item_id string, embedding array<float>, label string, split string"


def make(spark, rows):
    return spark.createDataFrame(rows, STORE)


def test_perfect_ranking(spark):
    store = make(spark, [(0, "a", [1.0, 0.0], "x", "index"), (1, "b", [0.0, 1.0], "y", "index"),
                         (2, "c", [1.0, 0.1], "x", "query"), (3, "d", [0.1, 1.0], "y", "query")])
    rows = metrics.summarize(metrics.evaluate_queries(store, 1)).collect()
    assert len(rows) == 3
    for row in rows:
        assert row["precision_at_k"] == row["recall_at_k"] == row["map_at_k"] == row["ndcg_at_k"] == 1.0


def test_skip_rule(spark):
    store = make(spark, [(0, "a", [1.0, 0.0], "x", "index"), (1, "b", [0.0, 1.0], None, "index"),
                         (2, "c", [1.0, 0.1], "x", "query"), (3, "d", [1.0, 0.2], None, "query"),
                         (4, "e", [1.0, 0.3], "lost", "query")])
    counts = metrics.skip_counts(store).first()
    assert (counts["evaluated_queries"], counts["skipped_queries"], counts["unlabeled_queries"]) == (1, 2, 1)
    assert metrics.evaluate_queries(store, 1).count() == 1


def test_partial_ranking(spark):
    store = make(spark, [(0, "hit", [1.0, 0.0], "x", "index"), (1, "miss", [0.9, 0.5], "y", "index"),
                         (2, "q", [1.0, 0.0], "x", "query")])
    row = metrics.evaluate_queries(store, 2).first()
    assert (row["precision_at_k"], row["recall_at_k"], row["average_precision_at_k"], row["ndcg_at_k"]) == (0.5, 1, 1, 1)


def test_k_too_large_and_empty_sides(spark):
    store = make(spark, [(0, "a", [1.0, 0.0], "x", "index"), (1, "b", [1.0, 0.0], "x", "query")])
    assert [r["rule"] for r in metrics.evaluation_violations(store, 2).collect()] == ["k cannot exceed the number of index items"]
    assert metrics.evaluation_violations(store, 1).count() == 0
    rules = {r["rule"] for r in metrics.evaluation_violations(store.filter("split = 'index'"), 1).collect()}
    assert rules == {"evaluation requires query items"}


MULTI = "item_id string, labels array<string>, partition string"


def multi(spark):
    store = make(spark, [(0, "i0", [1.0, 0.0], None, "index"), (1, "i1", [0.9, 0.3], None, "index"),
                         (2, "i2", [0.1, 1.0], None, "index"), (3, "q", [1.0, 0.05], None, "query"),
                         (4, "f", [float("nan"), 0.0], None, "query")])
    relevance = spark.createDataFrame(
        [("i0", ["a"], "index"), ("i1", ["c"], "index"), ("i2", ["a", "b"], "index"),
         ("q", ["a", "b"], "development"), ("f", ["a"], "final")], MULTI)
    return store, relevance


def test_multilabel_hand_case(spark):
    store, relevance = multi(spark)
    scored = multilabel.evaluate_development(store, relevance, 3, 0.5)
    row = scored.first()
    assert row["precision_at_k"] == pytest.approx(2 / 3)
    assert row["recall_at_k"] == 1
    assert row["average_precision_at_k"] == pytest.approx((1 + 2 / 3) / 2)
    assert row["ndcg_at_k"] == pytest.approx((0.5 + 1 / 2) / (1 + 0.5 / math.log2(3)))
    counts = multilabel.partition_counts(relevance, scored).first()
    assert (counts["final_queries_held_out"], counts["evaluated_queries"], counts["skipped_queries"]) == (1, 1, 0)
    first = multilabel.evaluate_development(store, relevance, 1, 0.5).first()
    assert (first["precision_at_k"], first["recall_at_k"], first["average_precision_at_k"], first["ndcg_at_k"]) == (1, 0.5, 1, 0.5)
    with pytest.raises(ValueError):
        multilabel.evaluate_development(store, relevance, 1, 0.4)


def test_query_without_positives_stays_in(spark):
    store, relevance = multi(spark)
    lonely = relevance.withColumn("labels", F.when(F.col("item_id") == "q", F.array(F.lit("c"), F.lit("d"), F.lit("e"))).otherwise(F.col("labels")))
    row = multilabel.evaluate_development(store, lonely, 3, 0.5).first()
    assert (row["recall_at_k"], row["average_precision_at_k"], row["total_relevant"]) == (0, 0, 0)
    assert row["ndcg_at_k"] > 0


def test_unhealthy_vectors_do_not_rank_silently(spark):
    store = make(spark, [(0, "a", [0.0, 0.0], "x", "index"), (1, "b", [1.0, 0.0], "x", "query")])
    with pytest.raises(Exception, match="finite and non-zero"):
        metrics.evaluate_queries(store, 1).collect()


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["a", "a"], ["a"]), ([], [])], "x array<string>, y array<string>")
    got = [r[0] for r in df.select(vectors.jaccard(F.col("x"), F.col("y"))).collect()]
    assert got == pytest.approx([1 / 3, 1, 0])


def test_normalise_and_defects(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],),
                                ([float("inf"), 1.0],), ([1e30, 1.0],), ([],)], "v array<float>")
    good = spark.createDataFrame([([3.0, 4.0],), ([0.0, 2.0],)], "v array<float>")
    rows = good.select(vectors.l2_normalize(F.col("v")).alias("u"), F.lit(1)).collect()
    assert rows[0]["u"] == pytest.approx([0.6, 0.8]) and rows[1]["u"] == [0, 1]
    defects = [r[0] for r in df.select(vectors.vector_defect(F.col("v"))).collect()]
    assert defects == [None, None, "zero_norm", "non_finite", "non_finite", "norm_overflow", "empty"]


def test_slices_pool_back_to_the_headline(spark, sf_dir):
    from orbitrank.plans import slices as plans

    scored, places = plans.all_scored(spark, sf_dir), plans.query_places(spark, sf_dir)
    overall = {r["store"]: r for r in metrics.mean_metrics(scored, ["store"]).collect()}
    for sliced in (slices.latitude_slices(scored, places), slices.distance_quartiles(scored, places, "nearest_index_m")):
        pooled = sliced.groupBy("store").agg(
            F.sum("evaluated_queries").alias("n"),
            (F.sum(F.col("map_at_k") * F.col("evaluated_queries")) / F.sum("evaluated_queries")).alias("m"))
        for row in pooled.collect():
            assert row["n"] == overall[row["store"]]["evaluated_queries"]
            assert row["m"] == pytest.approx(overall[row["store"]]["map_at_k"])


def test_agreement_divides_by_k_and_census_orders(spark):
    hits = spark.createDataFrame(
        [(s, q, r, i, rel) for s, q, r, i, rel in [
            ("a", "1", 1, "x", 1), ("a", "1", 2, "y", 0), ("b", "1", 1, "x", 1), ("b", "1", 2, "z", 0),
            ("a", "2", 1, "x", 0), ("b", "2", 1, "x", 1), ("a", "3", 1, "w", 1)]],
        "store string, query_id string, rank int, item_id string, relevant int")
    row = slices.agreement(hits, ["b", "a"], 4).first()
    assert (row["pair"], row["queries"], row["mean_overlap_at_k"]) == ("a vs b", 2, 0.25)
    assert [(r["correct"], r["queries"], r["disputed"]) for r in slices.agreement_census(hits, ["a", "b"]).collect()] == [
        ("a, b", 1, False), ("b", 1, True)]
    with pytest.raises(ValueError):
        slices.agreement(hits, ["a"], 4)


def test_evaluation_is_refused(spark):
    store = make(spark, [(0, "a", [1.0, 0.0], "x", "index"), (1, "b", [1.0, 0.0], "x", "query")])
    with pytest.raises(ValueError, match="k cannot exceed"):
        metrics.evaluate_queries(store, 2)
    with pytest.raises(ValueError, match="requires index items"):
        metrics.evaluate_queries(store.filter("split = 'query'"), 1)
    with pytest.raises(ValueError, match="requires query items"):
        metrics.evaluate_queries(store.filter("split = 'index'"), 1)


def test_multilabel_evaluation_is_refused(spark):
    store, relevance = multi(spark)
    rules = lambda *args: sorted({r["rule"] for r in multilabel.multilabel_violations(*args).collect()})
    plain = store.drop("label")
    assert rules(plain, relevance, 3, "h", "h") == []
    assert rules(store.withColumn("label", F.lit("x")), relevance, 3) == ["label_in_store"]
    assert rules(plain, relevance, 3, "h", "g") == ["different_manifests"]
    assert rules(plain, relevance, 0) == rules(plain, relevance, 4) == ["k_out_of_range"]
    assert rules(plain, relevance.filter("partition = 'index'"), 1) == ["missing_relevance", "no_development_queries"]
    swapped = relevance.withColumn("partition", F.when(F.col("item_id") == "q", "index").otherwise(F.col("partition")))
    assert "split_disagrees_with_partition" in rules(plain, swapped, 1)
    with pytest.raises(ValueError, match="k_out_of_range"):
        multilabel.evaluate_development(store, relevance, 4, 0.5)
    with pytest.raises(ValueError, match="missing_relevance"):
        multilabel.evaluate_development(store, relevance.filter("item_id <> 'f'"), 1, 0.5)
