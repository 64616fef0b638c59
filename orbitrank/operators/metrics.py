"""Per-query ranking metrics and their means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbitrank.operators.topk import exact_topk

METRICS = ("precision_at_k", "recall_at_k", "average_precision_at_k", "ndcg_at_k")


def index_side(store: DataFrame) -> DataFrame:
    return store.filter(F.col("split") == "index").select(
        "item_id", "position", F.col("label").alias("item_label"), F.col("embedding").alias("vector")
    )


def query_side(store: DataFrame) -> DataFrame:
    return store.filter(F.col("split") == "query").select(
        F.col("item_id").alias("query_id"), "label", F.col("embedding").alias("vector")
    )


def label_totals(store: DataFrame) -> DataFrame:
    """Index rows per label; NULL labels never count as relevant."""
    return (
        store.filter((F.col("split") == "index") & F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("total_relevant"))
    )


def eligible_queries(store: DataFrame) -> DataFrame:
    """Query rows with the number of index rows sharing their label (NULL if none)."""
    return query_side(store).join(label_totals(store), "label", "left")


def skip_counts(store: DataFrame) -> DataFrame:
    """How many queries are scored, and why the others are not."""
    return eligible_queries(store).agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("total_relevant").isNotNull()).alias("evaluated_queries"),
        F.count_if(F.col("total_relevant").isNull()).alias("skipped_queries"),
        F.count_if(F.col("label").isNull()).alias("unlabeled_queries"),
    )


def ranked_hits(store: DataFrame, k: int) -> DataFrame:
    """Hits of every scorable query with 0/1 relevance."""
    queries = eligible_queries(store).filter(F.col("total_relevant").isNotNull())
    hits = exact_topk(queries.select("query_id", "vector"), index_side(store), k)
    return hits.join(queries.select("query_id", "label", "total_relevant"), "query_id").select(
        "query_id",
        "label",
        "total_relevant",
        F.col("rank").cast("int").alias("rank"),
        "item_id",
        "item_label",
        "score",
        F.coalesce((F.col("item_label") == F.col("label")).cast("int"), F.lit(0)).alias("relevant"),
    )


def ideal_dcg(relevant: Column) -> Column:
    """DCG of a ranking whose first ``relevant`` rows are all relevant."""
    terms = F.transform(F.sequence(F.lit(1), relevant.cast("int")), lambda r: 1 / F.log2(r + 1))
    return F.when(
        relevant > 0, F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)
    ).otherwise(F.lit(0.0))


def score_queries(hits: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """One row of metrics per query (``keys``) from its ranked hits.

    Precision divides by what was retrieved, recall by all relevant index rows,
    average precision and the ideal gain by the smaller of the two.
    """
    running = (
        Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    relevant = F.col("relevant")
    found = hits.withColumn("running", F.sum("relevant").over(running))
    grouped = found.groupBy(*keys).agg(
        F.first("label").alias("label"),
        F.first("total_relevant").alias("total_relevant"),
        F.count(F.lit(1)).alias("retrieved"),
        F.sum("relevant").alias("found"),
        F.sum(relevant * F.col("running") / F.col("rank")).alias("precision_sum"),
        F.sum(relevant / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.max(F.when(F.col("rank") == 1, relevant)).alias("top_one"),
    )
    ideal = F.least("total_relevant", "retrieved")
    return grouped.select(
        *keys,
        "label",
        (F.col("found") / F.col("retrieved")).alias("precision_at_k"),
        (F.col("found") / F.col("total_relevant")).alias("recall_at_k"),
        (F.col("precision_sum") / ideal).alias("average_precision_at_k"),
        (F.col("dcg") / ideal_dcg(ideal)).alias("ndcg_at_k"),
        "top_one",
    )


def evaluate_queries(store: DataFrame, k: int) -> DataFrame:
    """Scores of every query; raises where the store cannot be evaluated at ``k``."""
    refused = evaluation_violations(store, k).limit(1).collect()
    if refused:
        raise ValueError(refused[0]["rule"])
    return score_queries(ranked_hits(store, k))


def evaluation_violations(store: DataFrame, k: int) -> DataFrame:
    """Why a store cannot be evaluated at ``k``: no index, no queries, or k too large."""
    sizes = store.agg(
        F.count_if(F.col("split") == "index").alias("index_items"),
        F.count_if(F.col("split") == "query").alias("query_items"),
    )
    rules = F.array_compact(
        F.array(
            F.when(F.col("index_items") == 0, F.lit("evaluation requires index items")),
            F.when(F.col("query_items") == 0, F.lit("evaluation requires query items")),
            F.when(F.col("index_items") < k, F.lit("k cannot exceed the number of index items")),
        )
    )
    return sizes.select(F.explode(rules).alias("rule"), "index_items", "query_items")


def mean_metrics(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The one mean every headline, class and slice goes through."""
    return scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("evaluated_queries"),
        F.avg("precision_at_k").alias("precision_at_k"),
        F.avg("recall_at_k").alias("recall_at_k"),
        F.avg("average_precision_at_k").alias("map_at_k"),
        F.avg("ndcg_at_k").alias("ndcg_at_k"),
    )


def summarize(scored: DataFrame) -> DataFrame:
    """Overall and per-class means in one pass; the overall row has a NULL label."""
    return (
        scored.groupingSets([[], [F.col("label")]], "label")
        .agg(
            F.grouping_id().alias("level"),
            F.count(F.lit(1)).alias("evaluated_queries"),
            F.avg("precision_at_k").alias("precision_at_k"),
            F.avg("recall_at_k").alias("recall_at_k"),
            F.avg("average_precision_at_k").alias("map_at_k"),
            F.avg("ndcg_at_k").alias("ndcg_at_k"),
        )
        .withColumn("scope", F.when(F.col("level") == 1, "all").otherwise("class"))
        .drop("level")
    )


def per_store(stores: Mapping[str, DataFrame], operator) -> DataFrame:
    """Apply ``operator`` to every store and stack the rows under a ``store`` column."""
    parts = [operator(df).withColumn("store", F.lit(name)) for name, df in sorted(stores.items())]
    return reduce(DataFrame.unionByName, parts)


def best_and_worst(scored: DataFrame) -> DataFrame:
    """Best and worst query of every class by (average precision, id).

    Both ends are ``max``/``min`` of a struct, so they combine map-side.
    """
    key = F.struct("average_precision_at_k", "query_id")
    ends = scored.groupBy("label").agg(F.max(key).alias("best"), F.min(key).alias("worst"))
    return ends.select(
        "label", F.explode(F.create_map(F.lit("best"), "best", F.lit("worst"), "worst")).alias("mode", "row")
    ).select("label", "mode", "row.query_id", "row.average_precision_at_k")


def ann_recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """Mean share of the exact top-k that an approximate top-k also returned."""
    shared = exact.select("query_id", "item_id").join(
        approximate.select("query_id", "item_id").withColumn("__hit", F.lit(1)),
        ["query_id", "item_id"],
        "left",
    )
    per_query = shared.groupBy("query_id").agg((F.count("__hit") / F.lit(k)).alias("overlap"))
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("overlap").alias("recall_at_k")
    )
