"""Registered queries that compare several stores or slice their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrank.operators import metrics, slices
from orbitrank.operators.nearest import guard_band, nearest_distance
from orbitrank.plans.bindings import (
    K, SQL_GEOGRAPHY, SQL_SCORED, SQL_STORE, SQL_STORES, flipped_vector, geography, written,
    sql_haversine, sql_hits, store, stores, with_sql,
)
from orbitrank.plans.registry import Registry, rounded
from orbitrank.plans.retrieval import _MEANS

REGISTRY = Registry()
QUERIES, ORACLES, register = REGISTRY.queries, REGISTRY.oracles, REGISTRY.add


NAMES = ["full", "half", "sparse"]


def all_hits(spark, sf_dir) -> DataFrame:
    """Hits of the three representations, ranked once and reused by every slice."""
    return written(
        spark, "hits",
        lambda: metrics.per_store(stores(spark, sf_dir), lambda s: metrics.ranked_hits(s, K)),
    )


def all_scored(spark, sf_dir, hits: DataFrame | None = None) -> DataFrame:
    """Scores of every query in each store; ``hits`` may hand in what ``all_hits`` ranked."""
    return written(
        spark, "scored",
        lambda: metrics.score_queries(all_hits(spark, sf_dir) if hits is None else hits, ["store", "query_id"]),
    )


def located(spark, sf_dir) -> DataFrame:
    return geography(store(spark, sf_dir)).drop("embedding")


def query_places(spark, sf_dir) -> DataFrame:
    return written(
        spark, "query_places", lambda: slices.query_geography(located(spark, sf_dir))
    )


_DISTANCE = sql_haversine("q.longitude", "q.latitude", "i.longitude", "i.latitude")
SQL_NEAREST = f"""
nearest AS (
  SELECT q.item_id AS query_id, q.position, q.longitude, q.latitude, q.spatial_group,
         min({_DISTANCE}) AS nearest_index_m,
         min(CASE WHEN i.label = q.label THEN {_DISTANCE} END) AS nearest_same_label_index_m
  FROM placed q, placed i WHERE q.split = 'query' AND i.split = 'index' GROUP BY ALL)"""
_ALL = with_sql(SQL_STORES, sql_hits("reps"), SQL_SCORED)
_GEO = with_sql(SQL_STORES, SQL_GEOGRAPHY, sql_hits("reps"), SQL_SCORED, SQL_NEAREST)
_GEO_ONLY = with_sql(SQL_STORE, SQL_GEOGRAPHY, SQL_NEAREST)


@register("nearest_distance", _GEO_ONLY + "SELECT query_id, round(nearest_index_m, 4) AS nearest_m FROM nearest")
def q_nearest(spark, sf_dir):
    items = located(spark, sf_dir)
    left = items.filter("split = 'query'").withColumn("left_id", F.col("item_id"))
    near = nearest_distance(left, items.filter("split = 'index'"))
    return near.select(F.col("left_id").alias("query_id"), F.round("nearest_m", 4).alias("nearest_m"))


@register("nearest_distance_descend", ORACLES["nearest_distance"])
def q_nearest_descend(spark, sf_dir):
    """The same, as if the reference points were too many to ship."""
    items = located(spark, sf_dir)
    left = items.filter("split = 'query'").withColumn("left_id", F.col("item_id"))
    near = nearest_distance(left, items.filter("split = 'index'"), shipped_points=0)
    return near.select(F.col("left_id").alias("query_id"), F.round("nearest_m", 4).alias("nearest_m"))


@register(
    "nearest_same_label",
    _GEO_ONLY + "SELECT query_id, round(nearest_same_label_index_m, 4) AS nearest_m FROM nearest",
)
def q_nearest_same(spark, sf_dir):
    items = located(spark, sf_dir)
    left = items.filter("split = 'query'").withColumn("left_id", F.col("item_id"))
    near = nearest_distance(left, items.filter("split = 'index'"), group="label")
    return near.select(F.col("left_id").alias("query_id"), F.round("nearest_m", 4).alias("nearest_m"))


@register(
    "guard_band",
    with_sql(SQL_STORE, SQL_GEOGRAPHY) + f"""SELECT i.item_id FROM placed i WHERE i.split = 'index' AND NOT EXISTS (
  SELECT 1 FROM placed q WHERE q.split = 'query' AND {_DISTANCE} < 500000.0)""",
)
def q_guard_band(spark, sf_dir):
    items = located(spark, sf_dir)
    left = items.filter("split = 'index'").withColumn("left_id", F.col("item_id"))
    return guard_band(left, items.filter("split = 'query'"), 500_000.0).select("item_id")


@register("guard_band_descend", ORACLES["guard_band"])
def q_guard_band_descend(spark, sf_dir):
    """The same, as if the reference points were too many to ship."""
    items = located(spark, sf_dir)
    left = items.filter("split = 'index'").withColumn("left_id", F.col("item_id"))
    return guard_band(left, items.filter("split = 'query'"), 500_000.0, shipped_points=0).select("item_id")


@register(
    "latitude_slices",
    _GEO + f"""SELECT store, printf('%+07.2f..%+07.2f', floor(latitude / 5.0) * 5.0, floor(latitude / 5.0) * 5.0 + 5.0) AS band,
  {_MEANS}, count(*) < 5 AS below_minimum_queries
FROM scored JOIN nearest USING (query_id) GROUP BY store, band""",
)
def q_latitude(spark, sf_dir):
    return rounded(slices.latitude_slices(all_scored(spark, sf_dir), query_places(spark, sf_dir)))


@register(
    "cell_spread",
    _GEO + """, cells AS (SELECT store, spatial_group, avg(average_precision_at_k) AS m, count(*) AS n
  FROM scored JOIN nearest USING (query_id) GROUP BY store, spatial_group)
SELECT store, count(*) AS groups, min(n) AS size_minimum, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS size_median,
  max(n) AS size_maximum, round(min(m), 6) AS map_minimum, round(quantile_cont(m, 0.1), 6) AS map_p10,
  round(quantile_cont(m, 0.5), 6) AS map_median, round(quantile_cont(m, 0.9), 6) AS map_p90,
  round(max(m), 6) AS map_maximum, round(stddev_pop(m), 6) AS map_standard_deviation
FROM cells GROUP BY store""",
)
def q_cell_spread(spark, sf_dir):
    return rounded(slices.cell_spread(all_scored(spark, sf_dir), query_places(spark, sf_dir)))


@register(
    "agreement",
    _ALL + """, ids AS (SELECT store, query_id, list(item_id) AS ids FROM hits GROUP BY store, query_id),
  shared AS (SELECT query_id FROM ids GROUP BY query_id HAVING count(*) = 3)
SELECT a.store || ' vs ' || b.store AS pair,
  round(avg(len(list_intersect(a.ids, b.ids)) / 10), 6) AS mean_overlap_at_k, count(*) AS queries
FROM ids a JOIN ids b ON a.query_id = b.query_id AND a.store < b.store
WHERE a.query_id IN (SELECT query_id FROM shared) GROUP BY pair""",
)
def q_agreement(spark, sf_dir):
    return rounded(slices.agreement(all_hits(spark, sf_dir), NAMES, K))


@register(
    "agreement_census",
    _ALL + """, who AS (SELECT query_id, string_agg(CASE WHEN top_one = 1 THEN store END, ', ' ORDER BY store) AS w,
  sum(top_one) AS n FROM scored GROUP BY query_id HAVING count(*) = 3)
SELECT coalesce(w, 'none') AS correct, count(*) AS queries, CAST(max(n) AS INTEGER) AS stores_correct,
  max(n) > 0 AND max(n) < 3 AS disputed FROM who GROUP BY coalesce(w, 'none')""",
)
def q_census(spark, sf_dir):
    return slices.agreement_census(all_hits(spark, sf_dir), NAMES)


_QUARTILE_SQL = """, dist AS (SELECT s.*, n.position, n.{a} AS distance FROM scored s JOIN nearest n USING (query_id)
  WHERE n.{a} IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY distance, position) - 1 AS r,
  count(*) OVER (PARTITION BY store) AS n FROM dist),
edges AS (SELECT store, quantile_cont(distance, [0, 0.25, 0.5, 0.75, 1]) AS e FROM dist GROUP BY store),
q AS (SELECT *, CAST(least(floor(r * 4 / n), 3) AS INTEGER) + 1 AS quartile FROM ranked)
SELECT store, quartile, {means}, round(min(distance), 3) AS minimum_m, round(max(distance), 3) AS maximum_m,
  round(any_value(e[quartile]), 3) AS edge_low_m, round(any_value(e[quartile + 1]), 3) AS edge_high_m
FROM q JOIN edges USING (store) GROUP BY store, quartile"""


def _quartiles(scored, places, attribute):
    found = slices.distance_quartiles(scored, places, attribute)
    metres = ("minimum_m", "maximum_m", "edge_low_m", "edge_high_m")
    return rounded(found).withColumns({c: F.round(c, 3) for c in metres})


@register("distance_quartiles", _GEO + _QUARTILE_SQL.format(a="nearest_index_m", means=_MEANS))
def q_quartiles(spark, sf_dir):
    return _quartiles(all_scored(spark, sf_dir), query_places(spark, sf_dir), "nearest_index_m")


@register(
    "distance_quartiles_same_label",
    _GEO + _QUARTILE_SQL.format(a="nearest_same_label_index_m", means=_MEANS),
)
def q_quartiles_same(spark, sf_dir):
    return _quartiles(all_scored(spark, sf_dir), query_places(spark, sf_dir), "nearest_same_label_index_m")


@register(
    "confusion",
    _ALL + """SELECT store, label, coalesce(item_label, 'unknown') AS retrieved, count(*) AS hits
FROM hits WHERE relevant = 0 GROUP BY store, label, coalesce(item_label, 'unknown')""",
)
def q_confusion(spark, sf_dir):
    return slices.confusion(all_hits(spark, sf_dir))


_HARD = """, hard AS (SELECT query_id, any_value(label) AS label, max(top_one) = 0 AS hard FROM scored
  GROUP BY query_id HAVING count(*) = 3)
"""


@register("hard_queries", _ALL + _HARD + "SELECT query_id, label FROM hard WHERE hard")
def q_hard(spark, sf_dir):
    return slices.hard_examples(all_scored(spark, sf_dir), NAMES)


@register(
    "hard_share",
    _ALL + _HARD + """SELECT count(*) FILTER (hard) AS hard_queries, count(*) AS shared_queries,
  round(count(*) FILTER (hard) / count(*), 6) AS share FROM hard""",
)
def q_hard_share(spark, sf_dir):
    return rounded(slices.hard_share(all_scored(spark, sf_dir), NAMES))


@register(
    "best_worst",
    _ALL + """, b AS (SELECT label, 'best' AS mode, query_id, average_precision_at_k,
    row_number() OVER (PARTITION BY label ORDER BY average_precision_at_k DESC, query_id DESC) AS r FROM scored WHERE store = 'full'
  UNION ALL SELECT label, 'worst', query_id, average_precision_at_k,
    row_number() OVER (PARTITION BY label ORDER BY average_precision_at_k, query_id) FROM scored WHERE store = 'full')
SELECT label, mode, query_id, round(average_precision_at_k, 6) AS average_precision_at_k FROM b WHERE r = 1""",
)
def q_best_worst(spark, sf_dir):
    full = all_scored(spark, sf_dir).filter(F.col("store") == "full")
    return rounded(metrics.best_and_worst(full))


@register(
    "compare_item",
    _ALL + """SELECT store, rank, item_id, item_label, round(score, 6) AS score, relevant = 1 AS relevant
FROM hits WHERE query_id = (SELECT min(query_id) FROM hits)""",
)
def q_compare(spark, sf_dir):
    hits = all_hits(spark, sf_dir)
    first = hits.agg(F.min("query_id")).first()[0]
    return rounded(slices.compare_item(hits, first))


@register(
    "vector_parity",
    with_sql(SQL_STORES) + """, p AS (SELECT a.e AS a, b.e AS b FROM reps a JOIN reps b USING (item_id)
  WHERE a.store = 'full' AND b.store = 'sparse'),
m AS (SELECT list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))) AS d,
  list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS c, sqrt(list_dot_product(a, a)) AS n,
  len(list_filter(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]) > 0.0001 + 0.00001 * abs(b[i]))) AS o FROM p)
SELECT count(*) AS items, count(*) FILTER (o > 0) = 0 AS allclose, round(max(d), 6) AS max_abs_difference,
  round(min(c), 6) AS min_paired_cosine, round(min(n), 6) AS norm_minimum, round(max(n), 6) AS norm_maximum FROM m""",
)
def q_parity(spark, sf_dir):
    reps = stores(spark, sf_dir)
    return rounded(slices.vector_parity(reps["full"], reps["sparse"], 1e-4, 1e-5))


@register(
    "vector_agreement",
    with_sql(SQL_STORE) + """, p AS (SELECT item_id, len(list_filter(range(1, 65), lambda i:
  CASE WHEN i % 3 = 0 THEN abs(e[i]) > 0.05 + 0.01 * 0 ELSE FALSE END)) AS n FROM store)
SELECT item_id, CAST(n AS INTEGER) AS components_outside FROM p WHERE n > 0""",
)
def q_vector_agreement(spark, sf_dir):
    full = store(spark, sf_dir)
    other = full.withColumn("embedding", flipped_vector(F.col("embedding")))
    return slices.vector_disagreements(full, other, 0.05, 0.01)


def tidy(df: DataFrame, section: str, keys: list[str]) -> DataFrame:
    """Stack the numeric columns of a report section as (section, store, slice, metric, value)."""
    numbers = [c for c, t in df.dtypes if c not in (*keys, "store") and t in ("double", "bigint", "int")]
    base = df if "store" in df.columns else df.withColumn("store", F.lit("all"))
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    wide = base.select("store", label.alias("slice"), *[F.col(c).cast("double").alias(c) for c in numbers])
    return wide.unpivot(["store", "slice"], numbers, "metric", "value").withColumn(
        "section", F.lit(section)
    )




def _tidy_sql(section: str, query: str, slice_sql: str, numbers: list[str], store: str = "store") -> str:
    """SQL of one report section: the section's own query, unpivoted."""
    listed = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in numbers)
    return (
        f"SELECT store, slice, metric, value, '{section}' AS section FROM (UNPIVOT "
        f"(SELECT {store} AS store, {slice_sql} AS slice, {listed} FROM ({query})) "
        f"ON {', '.join(numbers)} INTO NAME metric VALUE value)"
    )


_METRICS = ["evaluated_queries", "precision_at_k", "recall_at_k", "map_at_k", "ndcg_at_k"]
_SPREAD = ["groups", "size_minimum", "size_median", "size_maximum", "map_minimum", "map_p10", "map_median",
           "map_p90", "map_maximum", "map_standard_deviation"]
_METRES = ["minimum_m", "maximum_m", "edge_low_m", "edge_high_m"]
SQL_ANALYZE = " UNION ALL ".join([
    _tidy_sql("aggregate", _ALL + f"SELECT store, {_MEANS} FROM scored GROUP BY store", "'all'", _METRICS),
    _tidy_sql("latitude_bands", ORACLES["latitude_slices"], "band", _METRICS),
    _tidy_sql("spatial_group_spread", ORACLES["cell_spread"], "'all'", _SPREAD),
    _tidy_sql("pairwise_overlap", ORACLES["agreement"], "pair", ["mean_overlap_at_k", "queries"], "'all'"),
    _tidy_sql("correct_store_census", ORACLES["agreement_census"], "correct", ["queries", "stores_correct"], "'all'"),
    _tidy_sql("retrieved_when_wrong", ORACLES["confusion"], "label || '/' || retrieved", ["hits"]),
    _tidy_sql("universally_hard", ORACLES["hard_share"], "'all'", ["hard_queries", "shared_queries", "share"], "'all'"),
    _tidy_sql("nearest_index_m", ORACLES["distance_quartiles"], "CAST(quartile AS VARCHAR)", _METRICS + _METRES),
    _tidy_sql("nearest_same_label_index_m", ORACLES["distance_quartiles_same_label"], "CAST(quartile AS VARCHAR)",
              _METRICS + _METRES),
])


@register("analyze", SQL_ANALYZE)
def q_analyze(spark, sf_dir):
    """Every slice of the analysis as one tidy table over one ranked hits table."""
    hits = all_hits(spark, sf_dir)
    scored = all_scored(spark, sf_dir, hits)
    places = query_places(spark, sf_dir)
    sections = [
        tidy(metrics.mean_metrics(scored, ["store"]), "aggregate", []),
        tidy(slices.latitude_slices(scored, places), "latitude_bands", ["band"]),
        tidy(slices.cell_spread(scored, places), "spatial_group_spread", []),
        tidy(slices.agreement(hits, NAMES, K), "pairwise_overlap", ["pair"]),
        tidy(slices.agreement_census(hits, NAMES), "correct_store_census", ["correct"]),
        tidy(slices.confusion(hits), "retrieved_when_wrong", ["label", "retrieved"]),
        tidy(slices.hard_share(scored, NAMES), "universally_hard", []),
        *[
            tidy(_quartiles(scored, places, a), a, ["quartile"])
            for a in ("nearest_index_m", "nearest_same_label_index_m")
        ],
    ]
    return rounded(reduce(DataFrame.unionByName, sections))
