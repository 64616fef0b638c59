"""Registered queries over embedding stores: search, metrics, agreement, slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitrank.functions import vectors
from orbitrank.operators import metrics, topk
from orbitrank.operators.frames import stack
from orbitrank.operators.splits import hash_split
from orbitrank.plans.bindings import (
    K, SQL_SCORED, SQL_STORE, base_items, read, sql_hits, store, with_sql,
)
from orbitrank.plans.registry import Registry, rounded

REGISTRY = Registry()
QUERIES, ORACLES, register = REGISTRY.queries, REGISTRY.oracles, REGISTRY.add

_STORE_HITS = with_sql(SQL_STORE, sql_hits())
_STORE_SCORED = with_sql(SQL_STORE, sql_hits(), SQL_SCORED)
_MEANS = """count(*) AS evaluated_queries, round(avg(precision_at_k), 6) AS precision_at_k,
  round(avg(recall_at_k), 6) AS recall_at_k, round(avg(average_precision_at_k), 6) AS map_at_k,
  round(avg(ndcg_at_k), 6) AS ndcg_at_k"""


@register("hash_split", with_sql(SQL_STORE) + "SELECT item_id, split FROM base_split")
def q_hash_split(spark, sf_dir):
    return hash_split(base_items(spark, sf_dir), "content_key").select("item_id", "split")


@register(
    "exact_topk",
    with_sql(SQL_STORE) + """,
unit AS (SELECT *, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM store),
ranked AS (
  SELECT q.item_id AS query_id, i.item_id, round(list_dot_product(q.v, i.v), 9) AS score,
         CAST(row_number() OVER (PARTITION BY q.item_id ORDER BY
              round(list_dot_product(q.v, i.v), 9) DESC, i.position) AS INTEGER) AS rank
  FROM unit q, unit i WHERE q.split = 'query' AND i.split = 'index')
SELECT query_id, item_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10""",
)
def q_exact_topk(spark, sf_dir):
    return _exact_topk(spark, sf_dir, topk.SHIPPED_QUERY_BYTES)


def _exact_topk(spark, sf_dir, shipped_bytes):
    data = store(spark, sf_dir)
    hits = topk.exact_topk(
        metrics.query_side(data), metrics.index_side(data), K, shipped_bytes=shipped_bytes
    )
    return rounded(hits.select("query_id", "item_id", F.col("rank").cast("int").alias("rank"), "score"))


@register("exact_topk_grid", ORACLES["exact_topk"])
def q_exact_topk_grid(spark, sf_dir):
    """The same, as if the queries were too many to ship."""
    return _exact_topk(spark, sf_dir, 0)


@register("hits_relevance", _STORE_HITS + "SELECT query_id, rank, item_id, label, item_label, relevant FROM hits")
def q_hits_relevance(spark, sf_dir):
    return metrics.ranked_hits(store(spark, sf_dir), K).select(
        "query_id", "rank", "item_id", "label", "item_label", "relevant"
    )


@register(
    "eval_queries",
    _STORE_SCORED + """SELECT query_id, label, round(precision_at_k, 6) AS precision_at_k,
  round(recall_at_k, 6) AS recall_at_k, round(average_precision_at_k, 6) AS average_precision_at_k,
  round(ndcg_at_k, 6) AS ndcg_at_k, top_one FROM scored""",
)
def q_eval_queries(spark, sf_dir):
    return rounded(metrics.evaluate_queries(store(spark, sf_dir), K))


@register(
    "eval_skipped",
    with_sql(SQL_STORE) + """SELECT count(*) AS queries,
  count(*) FILTER (label IN (SELECT label FROM store WHERE split = 'index' AND label IS NOT NULL)) AS evaluated_queries,
  count(*) FILTER (label IS NULL OR label NOT IN (SELECT label FROM store WHERE split = 'index' AND label IS NOT NULL)) AS skipped_queries,
  count(*) FILTER (label IS NULL) AS unlabeled_queries
FROM store WHERE split = 'query'""",
)
def q_eval_skipped(spark, sf_dir):
    return metrics.skip_counts(store(spark, sf_dir))


@register("eval_summary", _STORE_SCORED + f"SELECT {_MEANS} FROM scored")
def q_eval_summary(spark, sf_dir):
    return rounded(metrics.mean_metrics(metrics.evaluate_queries(store(spark, sf_dir), K)))


@register(
    "eval_per_class",
    _STORE_SCORED + f"""SELECT 'class' AS scope, label, {_MEANS} FROM scored GROUP BY label
UNION ALL SELECT 'all', NULL, {_MEANS} FROM scored""",
)
def q_eval_per_class(spark, sf_dir):
    return rounded(metrics.summarize(metrics.evaluate_queries(store(spark, sf_dir), K)))


@register(
    "evaluation_violations",
    with_sql(SQL_STORE) + """, cases AS (
  SELECT 'one side' AS case_name, 0 AS index_items, count(*) FILTER (split = 'query') AS query_items, 1 AS k FROM store
  UNION ALL SELECT 'other side', count(*) FILTER (split = 'index'), 0, 1 FROM store
  UNION ALL SELECT 'large k', count(*) FILTER (split = 'index'), count(*) FILTER (split = 'query'), count(*) FILTER (split = 'index') + 1 FROM store
  UNION ALL SELECT 'largest k', count(*) FILTER (split = 'index'), count(*) FILTER (split = 'query'), count(*) FILTER (split = 'index') FROM store)
SELECT case_name, 'evaluation requires index items' AS rule, index_items, query_items FROM cases WHERE index_items = 0
UNION ALL SELECT case_name, 'evaluation requires query items', index_items, query_items FROM cases WHERE query_items = 0
UNION ALL SELECT case_name, 'k cannot exceed the number of index items', index_items, query_items FROM cases WHERE index_items < k""",
)
def q_evaluation_violations(spark, sf_dir):
    """The store without either side, and at the largest k and one more."""
    rows = store(spark, sf_dir)
    n = rows.filter("split = 'index'").count()
    cases = {
        "one side": (rows.filter("split = 'query'"), 1), "other side": (rows.filter("split = 'index'"), 1),
        "large k": (rows, n + 1), "largest k": (rows, n),
    }
    return stack(*[
        metrics.evaluation_violations(df, k).withColumn("case_name", F.lit(name)) for name, (df, k) in cases.items()
    ])
