"""Multi-label evaluation by Jaccard overlap of label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbitrank.functions.vectors import jaccard
from orbitrank.operators.checks import Rule, enforce, violations
from orbitrank.operators.frames import beside, stack
from orbitrank.operators.topk import exact_topk

THRESHOLDS = (0.3, 0.5, 0.7)
METRICS = ("precision_at_k", "recall_at_k", "average_precision_at_k", "ndcg_at_k")


def relevance_violations(store: DataFrame, relevance: DataFrame) -> DataFrame:
    """Ids on one side only, and splits that disagree with the relevance partition."""
    expected = F.when(F.col("partition") == "index", "index").otherwise("query")
    bound = store.select("item_id", "split", F.lit(True).alias("__s")).join(
        relevance.select("item_id", "partition", F.lit(True).alias("__r")), "item_id", "full_outer"
    )
    rule = (
        F.when(F.col("__r").isNull(), "missing_relevance")
        .when(F.col("__s").isNull(), "missing_embedding")
        .when(F.col("split") != expected, "split_disagrees_with_partition")
    )
    return bound.select(rule.alias("rule"), F.col("item_id").alias("key")).filter("rule IS NOT NULL")


def multilabel_violations(
    store: DataFrame, relevance: DataFrame, k: int,
    store_manifest: str | None = None, relevance_manifest: str | None = None,
) -> DataFrame:
    """Why a store cannot be scored at ``k`` with these judgments: rule and key, none if it can.

    Beside ids and splits: judgments left in the store's own labels, hashes of different
    manifests, a side without items, and a k outside 1 to the number of index items.
    """
    def facts(*rules: Rule) -> DataFrame:
        sizes = relevance.agg(
            F.count_if(F.col("partition") == "index").alias("index_items"),
            F.count_if(F.col("partition") == "development").alias("queries"),
        ).withColumn("all", F.lit("all"))
        return violations(sizes, "all", list(rules))

    found = [
        relevance_violations(store, relevance),
        facts(
            Rule("different_manifests", F.lit(store_manifest != relevance_manifest)),
            Rule("no_index_items", F.col("index_items") == 0),
            Rule("no_development_queries", F.col("queries") == 0),
            Rule("k_out_of_range", F.lit(k < 1) | (F.col("index_items") < k)),
        ),
    ]
    if "label" in store.columns:
        found.append(violations(store, "item_id", [Rule("label_in_store", F.col("label").isNotNull())]))
    return stack(*found)


def _label_key(labels) -> F.Column:
    """Canonical text of a label set, so equal sets meet by one string key."""
    return F.to_json(F.array_sort(F.array_distinct(labels)))


def graded_totals(queries: DataFrame, index: DataFrame) -> DataFrame:
    """How many index rows give each gain, per distinct query label set.

    Rows collapse to distinct label sets on both sides first, so the inverted
    join on shared labels grows with the number of label sets, not with rows.
    Rows: (query_key, gain, rows), positive gains only.
    """
    def sets(df: DataFrame, side: str) -> DataFrame:
        keyed = df.select(_label_key(F.col("labels")).alias(f"{side}_key"),
                          F.array_distinct("labels").alias(f"{side}_labels"))
        return keyed.groupBy(f"{side}_key").agg(
            F.first(f"{side}_labels").alias(f"{side}_labels"),
            F.count(F.lit(1)).alias(f"{side}_rows"),
        )

    left = sets(queries, "query").select(
        "query_key", F.size("query_labels").alias("query_size"), F.explode("query_labels").alias("label")
    )
    right = sets(index, "index").select(
        "index_key", "index_rows", F.size("index_labels").alias("index_size"),
        F.explode("index_labels").alias("label"),
    )
    shared = (
        left.join(right, "label")
        .groupBy("query_key", "index_key", "query_size", "index_size", "index_rows")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    gain = F.col("shared") / (F.col("query_size") + F.col("index_size") - F.col("shared"))
    return (
        shared.select("query_key", "index_rows", gain.alias("gain"))
        .groupBy("query_key", "gain")
        .agg(F.sum("index_rows").alias("rows"))
    )


def ideal_gains(totals: DataFrame, k: int, threshold: float) -> DataFrame:
    """Per query label set: relevant index rows and the DCG of the best k gains."""
    order = (
        Window.partitionBy("query_key")
        .orderBy(F.desc("gain"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = totals.withColumn("before", F.coalesce(F.sum("rows").over(order), F.lit(0)))
    last = F.least(F.col("before") + F.col("rows"), F.lit(k))
    discounts = F.transform(
        F.sequence((F.col("before") + 1).cast("int"), last.cast("int")),
        lambda r: F.lit(1.0) / F.log2(r + 1),
    )
    share = F.when(
        F.col("before") < k,
        F.col("gain") * F.aggregate(discounts, F.lit(0.0), lambda total, x: total + x),
    ).otherwise(F.lit(0.0))
    return runs.groupBy("query_key").agg(
        F.sum(F.when(F.col("gain") >= threshold, F.col("rows")).otherwise(0)).alias("total_relevant"),
        F.sum(share).alias("ideal_dcg"),
    )


def bind(store: DataFrame, relevance: DataFrame) -> DataFrame:
    """Embeddings with labels and partition; held-out rows leave before any maths."""
    return store.select("item_id", "position", "embedding").join(
        relevance.filter(F.col("partition") != "final").select("item_id", "labels", "partition"),
        "item_id",
    )


def evaluate_development(
    store: DataFrame, relevance: DataFrame, k: int = 10, threshold: float = 0.5
) -> DataFrame:
    """Per-query metrics of the development partition.

    Binary relevance is gain >= threshold; nDCG uses the raw gain. A query without
    any relevant index row scores zero on the binary metrics and stays in.
    """
    if threshold not in THRESHOLDS:
        raise ValueError("threshold must be one of 0.3, 0.5, 0.7")
    # The store's own labels are judged by another evaluation and are not looked at here.
    enforce(multilabel_violations(store.select("item_id", "split"), relevance, k))
    bound = bind(store, relevance)
    index = bound.filter(F.col("partition") == "index")
    queries = bound.filter((F.col("partition") == "development") & (F.size("labels") > 0)).select(
        F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"), "labels"
    )
    hits = exact_topk(
        queries,
        index.select("item_id", "position", F.to_json("labels").alias("item_label"),
                     F.col("embedding").alias("vector")),
        k,
    )
    ideal = ideal_gains(
        graded_totals(
            relevance.filter((F.col("partition") == "development") & (F.size("labels") > 0)),
            relevance.filter(F.col("partition") == "index"),
        ),
        k, threshold,
    )
    judged = queries.select("query_id", "labels", _label_key(F.col("labels")).alias("query_key"))
    judged = judged.join(ideal, "query_key", "left")
    graded = hits.join(judged, "query_id").withColumn(
        "gain", jaccard(F.col("labels"), F.from_json("item_label", "array<string>"))
    )
    relevant = F.when(F.col("gain") >= threshold, 1).otherwise(0)
    running = (
        Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    graded = graded.withColumn("relevant", relevant).withColumn(
        "running", F.sum("relevant").over(running)
    )
    grouped = graded.groupBy("query_id").agg(
        F.first("labels").alias("labels"),
        F.coalesce(F.first("total_relevant"), F.lit(0)).alias("total_relevant"),
        F.coalesce(F.first("ideal_dcg"), F.lit(0.0)).alias("ideal_dcg"),
        F.sum("relevant").alias("found"),
        F.sum(F.col("relevant") * F.col("running") / F.col("rank")).alias("precision_sum"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    any_relevant = F.col("total_relevant") > 0
    return grouped.select(
        "query_id",
        "labels",
        "total_relevant",
        (F.col("found") / F.lit(k)).alias("precision_at_k"),
        F.when(any_relevant, F.col("found") / F.col("total_relevant")).otherwise(0.0).alias("recall_at_k"),
        F.when(any_relevant, F.col("precision_sum") / F.least("total_relevant", F.lit(k)))
        .otherwise(0.0).alias("average_precision_at_k"),
        F.when(F.col("ideal_dcg") > 0, F.col("dcg") / F.col("ideal_dcg")).otherwise(0.0).alias("ndcg_at_k"),
    )


def by_label(scored: DataFrame) -> DataFrame:
    """A query counts in every one of its labels."""
    return scored.withColumn("label", F.explode("labels"))


def partition_counts(relevance: DataFrame, scored: DataFrame) -> DataFrame:
    """Skipped, held-out and no-positive counts beside the evaluated ones."""
    judged = relevance.agg(
        F.count_if((F.col("partition") == "development") & (F.size("labels") == 0)).alias("skipped_queries"),
        F.count_if(F.col("partition") == "final").alias("final_queries_held_out"),
    )
    counted = scored.agg(
        F.count(F.lit(1)).alias("evaluated_queries"),
        F.count_if(F.col("total_relevant") == 0).alias("queries_without_binary_positives"),
    )
    return beside(judged, counted)
