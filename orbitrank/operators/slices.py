"""Structure behind the headline metrics: geography, distance, agreement, errors."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrank.functions.geo import latitude_band
from orbitrank.functions.vectors import as_double, cosine, sum_of_squares
from orbitrank.operators.metrics import mean_metrics
from orbitrank.operators.nearest import nearest_distance
from orbitrank.operators.ranking import exact_quantiles, running_counts, value_rank
from orbitrank.session import cut_lineage

MINIMUM_SLICE_QUERIES = 5


def query_geography(items: DataFrame) -> DataFrame:
    """Every query with its metres to the index, of any label and of its own."""
    queries = items.filter(F.col("split") == "query").withColumn("left_id", F.col("item_id"))
    index = items.filter(F.col("split") == "index")
    anywhere = nearest_distance(queries, index).withColumnRenamed("nearest_m", "nearest_index_m")
    same = nearest_distance(queries, index, group="label").withColumnRenamed(
        "nearest_m", "nearest_same_label_index_m"
    )
    return (
        queries.join(anywhere, "left_id")
        .join(same, "left_id")
        .select(
            F.col("item_id").alias("query_id"),
            "position",
            "longitude",
            "latitude",
            F.coalesce("spatial_group", F.lit("unknown")).alias("spatial_group"),
            "nearest_index_m",
            "nearest_same_label_index_m",
        )
    )


def latitude_slices(scored: DataFrame, geography: DataFrame, degrees: float = 5.0) -> DataFrame:
    located = scored.join(geography.select("query_id", "latitude"), "query_id")
    banded = located.withColumn("band", latitude_band(F.col("latitude"), degrees))
    return mean_metrics(banded, ["store", "band"]).withColumn(
        "below_minimum_queries", F.col("evaluated_queries") < MINIMUM_SLICE_QUERIES
    )


def cell_spread(scored: DataFrame, geography: DataFrame) -> DataFrame:
    """Spread of per-cell mean average precision; at most one row per cell is sorted."""
    located = scored.join(geography.select("query_id", "spatial_group"), "query_id")
    cells = located.groupBy("store", "spatial_group").agg(
        F.avg("average_precision_at_k").alias("mean"), F.count(F.lit(1)).alias("size")
    )
    return cells.groupBy("store").agg(
        F.count(F.lit(1)).alias("groups"),
        F.min("size").alias("size_minimum"),
        F.median("size").alias("size_median"),
        F.max("size").alias("size_maximum"),
        F.min("mean").alias("map_minimum"),
        F.percentile("mean", F.lit(0.1)).alias("map_p10"),
        F.median("mean").alias("map_median"),
        F.percentile("mean", F.lit(0.9)).alias("map_p90"),
        F.max("mean").alias("map_maximum"),
        F.stddev_pop("mean").alias("map_standard_deviation"),
    )


def shared_rankings(hits: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per query that every store evaluated: its k ids and first hit per store."""
    wide = (
        hits.groupBy("query_id")
        .pivot("store", list(names))
        .agg(
            F.collect_set("item_id").alias("ids"),
            F.max(F.when(F.col("rank") == 1, F.col("relevant"))).alias("top"),
        )
    )
    present = F.lit(True)
    for name in names:
        present = present & F.col(f"`{name}_top`").isNotNull()
    return wide.filter(present)


def agreement(hits: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """Mean overlap@k of every pair of stores, divided by k."""
    names = sorted(names)
    if len(names) < 2:
        raise ValueError("one store agrees with nobody: give two or more")
    shared = shared_rankings(hits, names)
    pairs = [
        F.struct(
            F.lit(f"{a} vs {b}").alias("pair"),
            (F.size(F.array_intersect(f"`{a}_ids`", f"`{b}_ids`")) / F.lit(k)).alias("overlap"),
        )
        for a, b in combinations(names, 2)
    ]
    return (
        shared.select(F.explode(F.array(*pairs)).alias("p"))
        .groupBy("p.pair")
        .agg(F.avg("p.overlap").alias("mean_overlap_at_k"), F.count(F.lit(1)).alias("queries"))
    )


def agreement_census(hits: DataFrame, names: Sequence[str]) -> DataFrame:
    """How often each set of stores has the first hit right, most frequent first."""
    names = sorted(names)
    shared = shared_rankings(hits, names)
    right = [F.when(F.col(f"`{name}_top`") == 1, F.lit(name)) for name in names]
    who = F.concat_ws(", ", *right)
    total = sum((F.col(f"`{name}_top`") for name in names), F.lit(0))
    return (
        shared.select(F.when(who == "", "none").otherwise(who).alias("correct"), total.alias("n"))
        .groupBy("correct")
        .agg(F.count(F.lit(1)).alias("queries"), F.max("n").alias("stores_correct"))
        .withColumn("disputed", (F.col("stores_correct") > 0) & (F.col("stores_correct") < len(names)))
        .orderBy(F.desc("queries"), "correct")
    )


def hard_queries(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """Queries whose first hit is wrong in every store that all of them share."""
    return (
        scored.groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("stores"),
            F.max("top_one").alias("any_right"),
            F.first("label").alias("label"),
        )
        .filter(F.col("stores") == len(names))
        .withColumn("hard", F.col("any_right") == 0)
        .drop("stores", "any_right")
    )


def hard_share(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    flagged = hard_queries(scored, names)
    return flagged.agg(
        F.count_if("hard").alias("hard_queries"),
        F.count(F.lit(1)).alias("shared_queries"),
        F.coalesce(F.count_if("hard") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias(
            "share"
        ),
    )


def hard_examples(scored: DataFrame, names: Sequence[str], listed: int | None = None) -> DataFrame:
    """All hard queries, or the first ``listed`` by id, as a report shows them."""
    hard = hard_queries(scored, names).filter("hard").select("query_id", "label")
    return hard if listed is None else hard.orderBy("query_id").limit(listed)


def confusion(hits: DataFrame) -> DataFrame:
    """What comes back instead, per store and true label."""
    return (
        hits.filter(F.col("relevant") == 0)
        .groupBy("store", "label", F.coalesce("item_label", F.lit("unknown")).alias("retrieved"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def distance_quartiles(scored: DataFrame, geography: DataFrame, attribute: str) -> DataFrame:
    """Metrics per distance quartile; rank r of n falls in bucket floor(4r/n).

    Ranking is by (distance, position). Fewer than four located queries give no
    rows for a store.
    """
    located = scored.join(
        geography.select("query_id", "position", F.col(attribute).alias("distance")), "query_id"
    ).filter(F.col("distance").isNotNull())
    # Read by several passes below: written once, one narrow row per scored query.
    located = cut_lineage(located)
    counts = cut_lineage(running_counts(located, ["store"], "distance"))
    ranked = value_rank(located, ["store"], "distance", "position", rank="__rank", counts=counts)
    bucket = F.least(F.floor(F.col("__rank") * 4 / F.col("total")), F.lit(3)).cast("int")
    placed = ranked.filter(F.col("total") >= 4).withColumn("quartile", bucket + 1)
    extent = placed.groupBy("store", "quartile").agg(
        F.min("distance").alias("minimum_m"), F.max("distance").alias("maximum_m")
    )
    edges = exact_quantiles(located, ["store"], "distance", [0.0, 0.25, 0.5, 0.75, 1.0], counts)
    edge = F.col("quantile")
    low = edges.select("store", (F.col("probability") * 4 + 1).cast("int").alias("quartile"),
                       edge.alias("edge_low_m"))
    high = edges.select("store", (F.col("probability") * 4).cast("int").alias("quartile"),
                        edge.alias("edge_high_m"))
    return (
        mean_metrics(placed, ["store", "quartile"])
        .join(extent, ["store", "quartile"])
        .join(low, ["store", "quartile"])
        .join(high, ["store", "quartile"])
    )


def compare_item(hits: DataFrame, query_id: str) -> DataFrame:
    """One item's rankings in every store; relevance is NULL for an unlabeled query."""
    return hits.filter(F.col("query_id") == query_id).select(
        "store", "rank", "item_id", "item_label", "score",
        F.when(F.col("label").isNotNull(), F.col("relevant") == 1).alias("relevant"),
    )


def vector_parity(left: DataFrame, right: DataFrame, atol: float, rtol: float) -> DataFrame:
    """How far two copies of a store differ: extremes of difference, cosine and norm."""
    a, b = as_double(F.col("a")), as_double(F.col("b"))
    joined = left.select("item_id", F.col("embedding").alias("a")).join(
        right.select("item_id", F.col("embedding").alias("b")), "item_id"
    )
    apart = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    outside = F.exists(
        F.zip_with(a, b, lambda x, y: F.abs(x - y) > atol + rtol * F.abs(y)), lambda bad: bad
    )
    measured = joined.select(
        F.array_max(apart).alias("difference"),
        outside.alias("outside"),
        cosine(F.col("a"), F.col("b")).alias("cosine"),
        F.sqrt(sum_of_squares(F.col("a"))).alias("norm"),
    )
    return measured.agg(
        F.count(F.lit(1)).alias("items"),
        (F.count_if("outside") == 0).alias("allclose"),
        F.max("difference").alias("max_abs_difference"),
        F.min("cosine").alias("min_paired_cosine"),
        F.min("norm").alias("norm_minimum"),
        F.max("norm").alias("norm_maximum"),
    )


def vector_disagreements(
    actual: DataFrame, expected: DataFrame, atol: float, rtol: float
) -> DataFrame:
    """Items whose re-projected vector leaves the tolerance around the stored one."""
    joined = actual.select("item_id", as_double(F.col("embedding")).alias("a")).join(
        expected.select("item_id", as_double(F.col("embedding")).alias("b")), "item_id"
    )
    flags = F.zip_with("a", "b", lambda x, y: F.abs(x - y) > atol + rtol * F.abs(y))
    components = F.size(F.filter(flags, lambda bad: bad))
    return joined.select("item_id", components.alias("components_outside")).filter(
        F.col("components_outside") > 0
    )
