"""Registered queries over relevance sets, candidates, splits and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitrank.functions import geo
from orbitrank.operators import coverage, metrics, multilabel, selection
from orbitrank.operators.splits import query_cells, spread_sample
from orbitrank.plans.bindings import (
    K, SQL_CANDIDATES, SQL_RELEVANCE, SQL_STORE, candidates, relevance, written, sql_haversine,
    store, used_members, with_sql,
)
from orbitrank.plans.registry import Registry, rounded

REGISTRY = Registry()
QUERIES, ORACLES, register = REGISTRY.queries, REGISTRY.oracles, REGISTRY.add

# ---- multi-label ------------------------------------------------------------

_MULTI = with_sql(SQL_STORE, SQL_RELEVANCE) + """,
u AS (SELECT *, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM relevance),
pairs AS (
  SELECT q.item_id AS query_id, q.labels, i.position, round(list_dot_product(q.v, i.v), 9) AS score,
    len(list_intersect(q.labels, i.labels)) / len(list_distinct(list_concat(q.labels, i.labels))) AS gain
  FROM u q, u i WHERE q."partition" = 'development' AND len(q.labels) > 0 AND i."partition" = 'index'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank,
    row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS ideal_rank FROM pairs),
cum AS (
  SELECT *, sum(CASE WHEN gain >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS c FROM ranked),
agg AS (
  SELECT query_id, any_value(labels) AS labels, count(*) FILTER (gain >= 0.5) AS total_relevant,
    count(*) FILTER (gain >= 0.5 AND rank <= 10) AS found,
    coalesce(sum(c / rank) FILTER (gain >= 0.5 AND rank <= 10), 0) AS ps,
    sum(gain / log2(rank + 1)) FILTER (rank <= 10) AS dcg,
    sum(gain / log2(ideal_rank + 1)) FILTER (ideal_rank <= 10) AS ideal
  FROM cum GROUP BY query_id),
scored AS (
  SELECT query_id, labels, total_relevant, found / 10 AS precision_at_k,
    CASE WHEN total_relevant > 0 THEN found / total_relevant ELSE 0.0 END AS recall_at_k,
    CASE WHEN total_relevant > 0 THEN ps / least(total_relevant, 10) ELSE 0.0 END AS average_precision_at_k,
    CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END AS ndcg_at_k FROM agg)
"""
_MEANS = """count(*) AS evaluated_queries, round(avg(precision_at_k), 6) AS precision_at_k,
  round(avg(recall_at_k), 6) AS recall_at_k, round(avg(average_precision_at_k), 6) AS map_at_k,
  round(avg(ndcg_at_k), 6) AS ndcg_at_k"""


def _scored(spark, sf_dir):
    return written(
        spark, "multilabel",
        lambda: multilabel.evaluate_development(store(spark, sf_dir), relevance(spark, sf_dir), K, 0.5),
    )


@register(
    "eval_multilabel_queries",
    _MULTI + """SELECT query_id, array_to_string(labels, ',') AS labels, total_relevant, round(precision_at_k, 6) AS precision_at_k,
  round(recall_at_k, 6) AS recall_at_k, round(average_precision_at_k, 6) AS average_precision_at_k,
  round(ndcg_at_k, 6) AS ndcg_at_k FROM scored""",
)
def q_multilabel_queries(spark, sf_dir):
    scored = multilabel.evaluate_development(store(spark, sf_dir), relevance(spark, sf_dir), K, 0.5)
    return rounded(scored.withColumn("labels", F.array_join("labels", ",")))


@register("eval_multilabel", _MULTI + f"SELECT {_MEANS} FROM scored")
def q_multilabel(spark, sf_dir):
    return rounded(metrics.mean_metrics(_scored(spark, sf_dir)))


@register(
    "eval_multilabel_per_label",
    _MULTI + f"SELECT label, {_MEANS} FROM (SELECT unnest(labels) AS label, * EXCLUDE (labels) FROM scored) GROUP BY label",
)
def q_multilabel_labels(spark, sf_dir):
    return rounded(metrics.mean_metrics(multilabel.by_label(_scored(spark, sf_dir)), ["label"]))


@register(
    "eval_multilabel_counts",
    _MULTI + """SELECT (SELECT count(*) FROM relevance WHERE "partition" = 'development' AND len(labels) = 0) AS skipped_queries,
  (SELECT count(*) FROM relevance WHERE "partition" = 'final') AS final_queries_held_out,
  count(*) AS evaluated_queries, count(*) FILTER (total_relevant = 0) AS queries_without_binary_positives FROM scored""",
)
def q_multilabel_counts(spark, sf_dir):
    return multilabel.partition_counts(relevance(spark, sf_dir), _scored(spark, sf_dir))


@register(
    "jaccard",
    with_sql(SQL_STORE, SQL_RELEVANCE) + """SELECT item_id, round(CASE WHEN len(list_distinct(list_concat(labels, ['1', '2']))) = 0 THEN 0.0
  ELSE len(list_intersect(labels, ['1', '2'])) / len(list_distinct(list_concat(labels, ['1', '2']))) END, 6) AS jaccard FROM relevance""",
)
def q_jaccard(spark, sf_dir):
    from orbitrank.functions.vectors import jaccard

    wanted = F.array(F.lit("1"), F.lit("2"))
    return rounded(relevance(spark, sf_dir).select("item_id", jaccard(F.col("labels"), wanted).alias("jaccard")))


@register(
    "relevance_bind",
    with_sql(SQL_STORE, SQL_RELEVANCE) + """SELECT CASE WHEN r.item_id IS NULL THEN 'missing_relevance'
    WHEN s.split <> CASE WHEN r."partition" = 'index' THEN 'index' ELSE 'query' END THEN 'split_disagrees_with_partition' END AS rule,
  s.item_id AS key FROM store s LEFT JOIN (SELECT item_id,
    CASE WHEN position % 23 = 1 THEN 'index' ELSE "partition" END AS "partition" FROM relevance WHERE position % 29 <> 3) r USING (item_id)
WHERE r.item_id IS NULL OR s.split <> CASE WHEN r."partition" = 'index' THEN 'index' ELSE 'query' END""",
)
def q_relevance_bind(spark, sf_dir):
    number = F.col("item_id").cast("bigint")
    damaged = relevance(spark, sf_dir).filter(number % 29 != 3).withColumn(
        "partition", F.when(number % 23 == 1, "index").otherwise(F.col("partition"))
    )
    return multilabel.relevance_violations(store(spark, sf_dir), damaged)


@register(
    "multilabel_violations",
    with_sql(SQL_STORE, SQL_RELEVANCE) + """, judged AS (SELECT item_id, CASE WHEN CAST(item_id AS BIGINT) % 23 = 1 THEN 'index' ELSE "partition" END AS part
  FROM relevance WHERE CAST(item_id AS BIGINT) % 29 <> 3 AND "partition" <> 'development'),
sizes AS (SELECT count(*) FILTER (part = 'index') AS n, count(*) FILTER (part = 'development') AS q FROM judged)
SELECT CASE WHEN j.item_id IS NULL THEN 'missing_relevance' WHEN s.item_id IS NULL THEN 'missing_embedding' ELSE 'split_disagrees_with_partition' END AS rule,
  coalesce(s.item_id, j.item_id) AS key FROM (SELECT * FROM store WHERE position % 31 <> 5) s FULL JOIN judged j USING (item_id)
  WHERE s.item_id IS NULL OR j.item_id IS NULL OR s.split <> CASE WHEN part = 'index' THEN 'index' ELSE 'query' END
UNION ALL SELECT 'label_in_store', item_id FROM store WHERE label IS NOT NULL AND position % 31 <> 5
UNION ALL SELECT 'no_development_queries', 'all' FROM sizes WHERE q = 0
UNION ALL SELECT 'k_out_of_range', 'all' FROM sizes WHERE n < 1000000000
UNION ALL SELECT 'different_manifests', 'all'""",
)
def q_multilabel_violations(spark, sf_dir):
    """A store and judgments with a fault in every rule that rows can break."""
    number = F.col("item_id").cast("bigint")
    judged = relevance(spark, sf_dir).filter((number % 29 != 3) & (F.col("partition") != "development")).withColumn(
        "partition", F.when(number % 23 == 1, "index").otherwise(F.col("partition"))
    )
    held = store(spark, sf_dir).filter("position % 31 <> 5")
    return multilabel.multilabel_violations(held, judged, 1_000_000_000, "abc", "abd")


# ---- spatial split ----------------------------------------------------------

_QPC, _IPC, _SEP = 20, 50, 5_000.0
SQL_QUERY_CELLS = """
cells AS (SELECT label, spatial_group, count(*) AS n, sha256('42:query-groups:' || spatial_group) AS o
  FROM candidates GROUP BY label, spatial_group),
short AS (SELECT spatial_group, n,
  coalesce(sum(n) OVER w, 0) < 20 OR count(*) OVER w < 10 AS short FROM cells
  WINDOW w AS (PARTITION BY label ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
query_cells AS (SELECT spatial_group, CAST(sum(n) AS BIGINT) AS candidates FROM short GROUP BY spatial_group HAVING bool_or(short))"""


def _sql_spread(source: str, name: str, count: int) -> str:
    return f"""
{name}_deep AS (SELECT *, row_number() OVER (PARTITION BY label, spatial_group
    ORDER BY sha256('42:{name}:' || label || ':' || spatial_group || ':' || member)) AS depth,
  sha256('42:{name}:' || label || ':' || spatial_group) AS cell_order FROM {source}),
{name}_pick AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY depth, cell_order) AS pick FROM {name}_deep),
{name}_sample AS (SELECT * EXCLUDE (depth, pick, cell_order) FROM {name}_pick WHERE pick <= {count})"""


_DIST = sql_haversine("c.longitude", "c.latitude", "q.longitude", "q.latitude")
SQL_SPLIT = f"""{SQL_QUERY_CELLS},
inside AS (SELECT * FROM candidates WHERE spatial_group IN (SELECT spatial_group FROM query_cells)),
{_sql_spread('inside', 'query', _QPC).strip()},
outside AS (SELECT * FROM candidates WHERE spatial_group NOT IN (SELECT spatial_group FROM query_cells)),
eligible AS (SELECT c.* FROM outside c WHERE NOT EXISTS (SELECT 1 FROM query_sample q WHERE {_DIST} < {_SEP})),
{_sql_spread('eligible', 'index', _IPC).strip()},
manifest AS (SELECT *, 'query' AS split FROM query_sample UNION ALL SELECT *, 'index' FROM index_sample)"""


@register("spatial_split_cells", with_sql(SQL_CANDIDATES, SQL_QUERY_CELLS) + "SELECT spatial_group, candidates FROM query_cells")
def q_split_cells(spark, sf_dir):
    return query_cells(candidates(spark, sf_dir), _QPC, 42)


@register(
    "spread_sample",
    with_sql(SQL_CANDIDATES, _sql_spread("candidates", "query", 40)) + "SELECT member, label, spatial_group FROM query_sample",
)
def q_spread(spark, sf_dir):
    return spread_sample(candidates(spark, sf_dir), 40, 42, "query").select("member", "label", "spatial_group")


@register("spread_sample_large", ORACLES["spread_sample"])
def q_spread_large(spark, sf_dir):
    """The same, as if more were drawn than a task may keep of a cell."""
    drawn = spread_sample(candidates(spark, sf_dir), 40, 42, "query", map_side=0)
    return drawn.select("member", "label", "spatial_group")


def _split_manifest(spark, sf_dir):
    return written(
        spark, "spatial_manifest",
        lambda: selection.spatial_split(candidates(spark, sf_dir), _QPC, _IPC, _SEP, 42).manifest(),
    )


@register("spatial_split", with_sql(SQL_CANDIDATES, SQL_SPLIT) + "SELECT member, label, split, spatial_group FROM manifest")
def q_split(spark, sf_dir):
    split = selection.spatial_split(candidates(spark, sf_dir), _QPC, _IPC, _SEP, 42)
    return split.manifest().select("member", "label", "split", "spatial_group")


@register(
    "spatial_split_excluded",
    with_sql(SQL_CANDIDATES, SQL_SPLIT)
    + "SELECT label, count(*) AS excluded FROM outside WHERE member NOT IN (SELECT member FROM eligible) GROUP BY label",
)
def q_split_excluded(spark, sf_dir):
    split = selection.spatial_split(candidates(spark, sf_dir), _QPC, _IPC, _SEP, 42)
    return split.excluded.groupBy("label").agg(F.count(F.lit(1)).alias("excluded"))


_AUDIT_DIST = sql_haversine("q.longitude", "q.latitude", "i.longitude", "i.latitude")


@register(
    "audit_spatial_split",
    with_sql(SQL_CANDIDATES, SQL_SPLIT) + f""",
m AS (SELECT *, CASE WHEN key % 13 = 2 THEN NULL ELSE label END AS lab,
  CASE WHEN key % 11 = 4 THEN 'query' ELSE split END AS sp, CASE WHEN key % 17 = 1 THEN 9000.0 ELSE 5000.0 END AS sep FROM manifest),
counts AS (SELECT lab, count(*) FILTER (sp = 'index') AS i, count(*) FILTER (sp = 'query') AS q FROM m GROUP BY lab),
near AS (SELECT min({_AUDIT_DIST}) AS d FROM m q, m i WHERE q.sp = 'query' AND i.sp = 'index')
SELECT 'unlabeled' AS rule, member AS key FROM m WHERE lab IS NULL
UNION ALL SELECT 'cell_crosses_splits', spatial_group FROM m GROUP BY spatial_group HAVING min(sp) <> max(sp)
UNION ALL SELECT 'inconsistent_separation_policy', 'all' FROM m HAVING min(sep) <> max(sep)
UNION ALL SELECT 'class_count_mismatch', lab FROM counts WHERE i <> 50 OR q <> 20
UNION ALL SELECT 'separation_below_declared', 'all' FROM near WHERE d + 0.000001 < (SELECT max(sep) FROM m)""",
)
def q_audit_split(spark, sf_dir):
    """A damaged copy of the split, so the audit has something to find."""
    split = _split_manifest(spark, sf_dir)
    damaged = split.select(
        F.col("member").alias("item_id"), F.lit("archive").alias("source"), "spatial_group", "longitude", "latitude",
        F.when(F.col("key") % 13 != 2, F.col("label")).alias("label"),
        F.when(F.col("key") % 11 == 4, "query").otherwise(F.col("split")).alias("split"),
        F.when(F.col("key") % 17 == 1, 9000.0).otherwise(5000.0).alias("minimum_separation_m"),
    )
    return selection.audit_spatial_split(damaged, candidates(spark, sf_dir), "archive", _IPC, _QPC)


# ---- coverage ---------------------------------------------------------------

_FREE = """, marked AS (SELECT *, spatial_group IN (SELECT spatial_group FROM used) AS spent FROM candidates)"""


@register(
    "cell_budget",
    with_sql(SQL_CANDIDATES) + _FREE + """SELECT count(*) AS total_patches, count(DISTINCT spatial_group) AS total_cells,
  (SELECT count(*) FROM used) AS used_patches, count(DISTINCT spatial_group) FILTER (spent) AS used_cells,
  count(DISTINCT spatial_group) FILTER (NOT spent) AS free_cells, count(*) FILTER (NOT spent) AS free_patches FROM marked""",
)
def q_budget(spark, sf_dir):
    return coverage.cell_budget(candidates(spark, sf_dir), used_members(spark, sf_dir))


@register(
    "cell_budget_labels",
    with_sql(SQL_CANDIDATES) + _FREE + """SELECT label, count(*) FILTER (NOT spent) AS free_patches,
  count(DISTINCT spatial_group) FILTER (NOT spent) AS free_cells FROM marked GROUP BY label""",
)
def q_budget_labels(spark, sf_dir):
    return coverage.cell_budget_by_label(candidates(spark, sf_dir), used_members(spark, sf_dir))


@register(
    "unknown_members",
    with_sql(SQL_CANDIDATES)
    + "SELECT 'm' || CAST(l_orderkey + 14900 AS VARCHAR) AS member FROM lineitem EXCEPT ALL SELECT m FROM (SELECT 'm' || CAST(l_orderkey + 14900 AS VARCHAR) AS m FROM lineitem) WHERE m IN (SELECT member FROM candidates)",
)
def q_unknown(spark, sf_dir):
    from orbitrank.plans.bindings import read

    used = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_orderkey") + 14900).cast("string")).alias("member")
    )
    return coverage.unknown_members(candidates(spark, sf_dir), used)


_NEAR = f""",
near AS (SELECT c.member, c.label, c.spatial_group, min({_DIST}) AS nearest_m FROM candidates c, used q
  WHERE c.member NOT IN (SELECT member FROM used) GROUP BY ALL)"""


def _distances(spark, sf_dir):
    def build():
        pool, used = candidates(spark, sf_dir), used_members(spark, sf_dir)
        return coverage.unused_distances(pool, used, used)

    return written(spark, "unused_distances", build)


@register(
    "distance_tiers",
    with_sql(SQL_CANDIDATES) + _NEAR + """, t AS (SELECT * FROM (VALUES ('5km', 5000.0), ('20km', 20000.0), ('60km', 60000.0)) v(tier, m))
SELECT tier, label, count(*) FILTER (nearest_m >= m) AS patches, count(DISTINCT spatial_group) FILTER (nearest_m >= m) AS cells
FROM near, t GROUP BY tier, label""",
)
def q_tiers(spark, sf_dir):
    return coverage.distance_tiers(_distances(spark, sf_dir), candidates(spark, sf_dir), (5, 20, 60))


@register(
    "distance_tier_summary",
    with_sql(SQL_CANDIDATES) + _NEAR + """, t AS (SELECT * FROM (VALUES ('5km', 5000.0), ('20km', 20000.0), ('60km', 60000.0)) v(tier, m)),
p AS (SELECT tier, label, count(*) FILTER (nearest_m >= m) AS patches FROM near, t GROUP BY tier, label)
SELECT tier, CAST(sum(patches) AS BIGINT) AS total, count(*) FILTER (patches > 0) AS labels_present, min(patches) AS min_label_patches FROM p GROUP BY tier""",
)
def q_tier_summary(spark, sf_dir):
    return coverage.tier_summary(
        coverage.distance_tiers(_distances(spark, sf_dir), candidates(spark, sf_dir), (5, 20, 60))
    )


@register(
    "distance_percentiles",
    with_sql(SQL_CANDIDATES) + _NEAR + """, q AS (SELECT quantile_cont(nearest_m / 1000, [0.05, 0.25, 0.5, 0.75, 0.95]) AS v FROM near)
SELECT 'p' || CAST([5, 25, 50, 75, 95][i] AS VARCHAR) AS percentile, CAST(round_even(v[i], 3) AS DOUBLE) AS km FROM q, range(1, 6) t(i)""",
)
def q_percentiles(spark, sf_dir):
    return coverage.distance_percentiles(_distances(spark, sf_dir))


# ---- scalar geography -------------------------------------------------------

@register(
    "haversine",
    with_sql(SQL_CANDIDATES) + f"SELECT member, round({sql_haversine('longitude', 'latitude', '9.0', '50.0')}, 4) AS metres FROM candidates",
)
def q_haversine(spark, sf_dir):
    metres = geo.haversine_m(F.col("longitude"), F.col("latitude"), F.lit(9.0), F.lit(50.0))
    return candidates(spark, sf_dir).select("member", F.round(metres, 4).alias("metres"))


@register("spatial_cell", with_sql(SQL_CANDIDATES) + "SELECT member, spatial_group FROM candidates")
def q_cell(spark, sf_dir):
    return candidates(spark, sf_dir).select("member", "spatial_group")


@register(
    "latitude_band",
    with_sql(SQL_STORE) + """SELECT item_id, printf('%+07.2f..%+07.2f', floor(lat / 2.5) * 2.5, floor(lat / 2.5) * 2.5 + 2.5) AS band
FROM (SELECT item_id, CAST(((position * 4729) % 14000) / 100.0 - 70.0 AS DOUBLE) AS lat FROM store)""",
)
def q_band(spark, sf_dir):
    from orbitrank.plans.bindings import lonlat

    items = store(spark, sf_dir)
    return items.select("item_id", geo.latitude_band(lonlat(F.col("position"))[1], 2.5).alias("band"))


@register(
    "hash_rank",
    with_sql(SQL_CANDIDATES) + "SELECT member, sha256('42:index:' || label || ':' || member) AS hash_order FROM candidates",
)
def q_hash_rank(spark, sf_dir):
    from orbitrank.functions.hashing import hashed_order

    return candidates(spark, sf_dir).select(
        "member", hashed_order(42, "index", F.col("label"), F.col("member")).alias("hash_order")
    )


def _xy():
    from orbitrank.plans.bindings import sql_equal_area

    return sql_equal_area("longitude", "latitude")


@register(
    "equal_area_xy",
    with_sql(SQL_CANDIDATES) + f"SELECT member, round({_xy()[0]}, 3) AS x, round({_xy()[1]}, 3) AS y FROM candidates",
)
def q_equal_area(spark, sf_dir):
    x, y = geo.equal_area_xy(F.col("longitude"), F.col("latitude"))
    return candidates(spark, sf_dir).select("member", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@register(
    "coord_violations",
    """SELECT CASE WHEN lon IS NULL OR lat IS NULL THEN 'non_finite' ELSE 'out_of_bounds' END AS rule, CAST(c_custkey AS VARCHAR) AS key
FROM (SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_acctbal / 40.0 END AS lon, c_acctbal / 80.0 AS lat FROM customer)
WHERE lon IS NULL OR lat IS NULL OR abs(lon) > 180 OR abs(lat) > 90""",
)
def q_coord(spark, sf_dir):
    from orbitrank.operators.checks import coordinate_violations
    from orbitrank.plans.bindings import read

    points = read(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 80.0).alias("latitude"),
        F.when(F.col("c_custkey") % 19 != 0, F.col("c_acctbal") / 40.0).alias("longitude"),
    )
    return coordinate_violations(points, "c_custkey")


@register(
    "bbox_violations",
    """SELECT rule, CAST(c_custkey AS VARCHAR) AS key FROM (SELECT c_custkey, CASE
  WHEN NOT (w >= -180 AND w < e AND e <= 180) THEN 'longitude_order' WHEN NOT (s >= -90 AND s < n AND n <= 90) THEN 'latitude_order' END AS rule
FROM (SELECT c_custkey, c_acctbal / 50.0 AS w, c_acctbal / 50.0 + (c_custkey % 7 - 1) AS e, c_acctbal / 100.0 AS s,
  c_acctbal / 100.0 + (c_custkey % 5 - 1) AS n FROM customer)) WHERE rule IS NOT NULL""",
)
def q_bbox(spark, sf_dir):
    from orbitrank.operators.checks import bbox_violations
    from orbitrank.plans.bindings import read

    a, k = F.col("c_acctbal"), F.col("c_custkey")
    boxes = read(spark, sf_dir, "customer").select(
        "c_custkey", (a / 50.0).alias("west"), (a / 50.0 + (k % 7 - 1)).alias("east"),
        (a / 100.0).alias("south"), (a / 100.0 + (k % 5 - 1)).alias("north"),
    )
    return bbox_violations(boxes, "c_custkey")
