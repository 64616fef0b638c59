"""Registered queries for representation, approximate search and streaming jobs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitrank.operators import ann, cell_index, metrics, represent
from orbitrank.operators.topk import exact_topk
from orbitrank.plans import slices as sliced
from orbitrank.plans.bindings import K, SQL_STORE, base_items, read, written, sql_hits, store, with_sql
from orbitrank.plans.registry import Registry, rounded
from orbitrank.session import scratch_path
from orbitrank.sources import stores as store_source
from orbitrank.streaming import jobs

REGISTRY = Registry()
QUERIES, ORACLES, register = REGISTRY.queries, REGISTRY.oracles, REGISTRY.add

COMPONENTS, CELLS = 16, 16
_UNIT = with_sql(SQL_STORE) + """, unit AS (SELECT *, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM store)
"""

# ---- representation ---------------------------------------------------------


def vectors_of(spark, sf_dir):
    return store(spark, sf_dir).withColumnRenamed("embedding", "vector")


@register("pca_fit")
def q_pca_fit(spark, sf_dir):
    """Explained share of every component, fitted on index rows."""
    basis = represent.fit_pca(vectors_of(spark, sf_dir), COMPONENTS)
    rows = [(i, float(v), float(np.linalg.norm(c))) for i, (v, c) in enumerate(zip(basis.explained, basis.components), 1)]
    return spark.createDataFrame(rows, "component int, explained_variance double, norm double")


def projected(spark, sf_dir):
    def build():
        basis = represent.fit_pca(vectors_of(spark, sf_dir), COMPONENTS)
        return represent.project(vectors_of(spark, sf_dir), basis)
    return written(spark, "projected", build)


@register("pca_embed")
def q_pca_embed(spark, sf_dir):
    return projected(spark, sf_dir).select(
        "item_id", "split", F.size("embedding").alias("dimension"), F.array_join(F.transform("embedding", lambda x: F.round(x, 6).cast("string")), ",").alias("embedding")
    )


@register("pca_summary")
def q_pca_summary(spark, sf_dir):
    """Ranking quality of the projected store."""
    return rounded(metrics.mean_metrics(metrics.evaluate_queries(projected(spark, sf_dir), K)))


@register(
    "projection_roundtrip",
    with_sql(SQL_STORE) + ", d AS (SELECT i, avg(e[i]) AS m FROM store, range(1, 65) t(i) WHERE split = 'index' GROUP BY i)\nSELECT 64 AS features, 16 AS components, round(sum(m * m), 6) AS mean_square, 'pca' AS store FROM d",
)
def q_projection(spark, sf_dir):
    basis = represent.fit_pca(vectors_of(spark, sf_dir), COMPONENTS)
    path = scratch_path(spark, "projection")
    store_source.save_projection(spark, path, basis.mean, basis.components, store="pca", image_size=8, seed=42)
    loaded = store_source.load_projection(spark, path)
    square = F.aggregate(F.col("mean").cast("array<double>"), F.lit(0.0), lambda t, x: t + x * x)
    return loaded.select(F.size("mean").alias("features"), F.size("components").alias("components"),
                         F.round(square, 6).alias("mean_square"), "store")


def pictures(spark, sf_dir):
    """Documents as images: whole texts as rows of sixteen three-byte pixels, zero padded."""
    body = F.encode("text", "utf-8")
    height = F.ceil(F.greatest(F.octet_length(body), F.lit(1)) / 48).cast("int")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"), height.alias("height"), F.lit(16).alias("width"),
        F.lit(3).alias("nChannels"), F.rpad(body, height * 48, F.lit(b"\x00")).alias("data"),
    )


@register("image_flatten")
def q_flatten(spark, sf_dir):
    flat = represent.flatten_images(pictures(spark, sf_dir), 8)
    mean = F.aggregate(F.col("pixels").cast("array<double>"), F.lit(0.0), lambda t, x: t + x) / F.size("pixels")
    return flat.select("item_id", F.size("pixels").alias("features"), F.round(mean, 6).alias("mean"))


def byte_encoder():
    """A frozen stand-in encoder: square roots of whole-text byte frequencies, folded to 64."""
    def encode(texts):
        rows = np.zeros((len(texts), 64))
        for i, text in enumerate(texts):
            codes = np.frombuffer((text or " ").encode("utf-8") or b" ", np.uint8)
            rows[i] = np.sqrt(np.bincount(codes % 64, minlength=64))
        return rows
    return encode


@register(
    "encode_batch",
    """SELECT CAST(doc_id AS VARCHAR) AS item_id, 1.0::DOUBLE AS norm, 64 AS dimension FROM documents""",
)
def q_encode(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item_id"), "text")
    found = represent.encode(docs, "text", byte_encoder, 64)
    norm = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x * x)
    return found.select("item_id", F.round(norm, 6).alias("norm"), F.size("embedding").alias("dimension"))


@register("query_new_item")
def q_new_items(spark, sf_dir):
    """Slightly disturbed vectors ranked through the projection the store was made with."""
    basis = represent.fit_pca(vectors_of(spark, sf_dir), COMPONENTS)
    fresh = base_items(spark, sf_dir).filter("position % 10 = 1").select(
        F.concat(F.lit("new-"), "item_id").alias("query_id"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.sin(i) * 0.01).alias("vector"),
    )
    described = spark.createDataFrame([("pca", "pca", "abc", 8, COMPONENTS)], "store string, backend string, manifest_sha256 string, image_size int, dimension int")
    hits = represent.query_new_items(fresh, projected(spark, sf_dir), described, K, basis, described)
    return rounded(hits.select("query_id", F.col("rank").cast("int").alias("rank"), "item_id", "score"))


@register(
    "query_by_id",
    _UNIT + """SELECT i.item_id, round(list_dot_product(q.v, i.v), 6) AS score, CAST(row_number() OVER (ORDER BY round(list_dot_product(q.v, i.v), 9) DESC, i.position) AS INTEGER) AS rank
FROM unit q, unit i WHERE q.item_id = (SELECT min(item_id) FROM store WHERE split = 'index') AND i.split = 'index' AND i.item_id <> q.item_id QUALIFY rank <= 10""",
)
def q_by_id(spark, sf_dir):
    rows = store(spark, sf_dir)
    first = rows.filter("split = 'index'").agg(F.min("item_id")).first()[0]
    hits = represent.query_by_id(rows, first, K)
    return rounded(hits.select("item_id", "score", F.col("rank").cast("int").alias("rank")))


# ---- approximate search -----------------------------------------------------

def _sides(spark, sf_dir):
    rows = store(spark, sf_dir)
    return metrics.query_side(rows), metrics.index_side(rows)


#: Coarse centres, fine ones of each, and what a query probes of both.
COARSE, FINE, PROBED_COARSE, PROBED = 4, 4, 3, 6
_INDEXES: dict[tuple, str] = {}


def saved_index(spark, sf_dir):
    """The saved index over the store's index side: an artifact, kept as the store is."""
    rows = store(spark, sf_dir)
    key = (spark.sparkContext.applicationId, *sorted(rows.inputFiles()))
    if key not in _INDEXES:
        path = scratch_path(spark, "cell-index")
        cell_index.save_index(metrics.index_side(rows), path, COARSE, FINE)
        _INDEXES[key] = path
    return cell_index.load_index(spark, _INDEXES[key])


SQL_CELLS = f""", idx AS (SELECT * FROM unit WHERE split = 'index'),
coarse AS (SELECT row_number() OVER (ORDER BY sha256('42:' || item_id)) - 1 AS c, v FROM idx QUALIFY c < {COARSE}),
placed AS (SELECT i.item_id, i.v, i.position, c.c FROM idx i, coarse c
  QUALIFY row_number() OVER (PARTITION BY i.item_id ORDER BY round(list_dot_product(i.v, c.v), 9) DESC, c.c) = 1),
fine AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY sha256('42:' || item_id)) - 1 AS f, v FROM placed QUALIFY f < {FINE}),
celled AS (SELECT p.item_id, p.v, p.position, p.c * {FINE} + f.f AS cell FROM placed p JOIN fine f USING (c)
  QUALIFY row_number() OVER (PARTITION BY p.item_id ORDER BY round(list_dot_product(p.v, f.v), 9) DESC, f.f) = 1),
near AS (SELECT q.item_id AS query_id, q.v, c.c FROM unit q, coarse c WHERE q.split = 'query'
  QUALIFY row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_dot_product(q.v, c.v), 9) DESC, c.c) <= {PROBED_COARSE}),
probes AS (SELECT query_id, n.v, n.c * {FINE} + f AS cell FROM near n JOIN fine USING (c)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(n.v, fine.v), 9) DESC, cell) <= {PROBED}),
found AS (SELECT query_id, i.item_id, round(list_dot_product(p.v, i.v), 6) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(p.v, i.v), 9) DESC, i.position) AS INTEGER) AS rank
  FROM probes p JOIN celled i USING (cell) QUALIFY rank <= {K})
"""


@register("ann_cells", _UNIT + SQL_CELLS + "SELECT cell, count(*) AS items FROM celled GROUP BY cell")
def q_ann_cells(spark, sf_dir):
    """How many vectors each cell of the saved index holds."""
    return saved_index(spark, sf_dir).vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("items"))


@register("ann_topk", _UNIT + SQL_CELLS + "SELECT query_id, item_id, score, rank FROM found")
def q_ann(spark, sf_dir):
    """Search of the saved index; nothing is fitted."""
    hits = saved_index(spark, sf_dir).topk(_sides(spark, sf_dir)[0], K, PROBED_COARSE, PROBED)
    return rounded(hits.select("query_id", F.col("rank").cast("int").alias("rank"), "item_id", "score"))


@register("ann_topk_all_cells", with_sql(SQL_STORE) + """, unit AS (SELECT *, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM store),
ranked AS (SELECT q.item_id AS query_id, i.item_id, CAST(row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_dot_product(q.v, i.v), 9) DESC, i.position) AS INTEGER) AS rank
  FROM unit q, unit i WHERE q.split = 'query' AND i.split = 'index')
SELECT query_id, item_id, rank FROM ranked WHERE rank <= 10""")
def q_ann_all(spark, sf_dir):
    """Probing every cell must give the exact answer."""
    queries, index = _sides(spark, sf_dir)
    hits = ann.CellIndex(index, CELLS).topk(queries, K, nprobe=CELLS)
    return hits.select("query_id", "item_id", F.col("rank").cast("int").alias("rank"))


@register("ann_hyperplanes")
def q_hyperplanes(spark, sf_dir):
    queries, index = _sides(spark, sf_dir)
    hits = ann.hyperplane_topk(queries, index, K, 64)
    return rounded(hits.select("query_id", F.col("rank").cast("int").alias("rank"), "item_id", "score"))


@register(
    "ann_recall",
    _UNIT + SQL_CELLS + f""", exact AS (SELECT q.item_id AS query_id, i.item_id FROM unit q, idx i WHERE q.split = 'query'
  QUALIFY row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_dot_product(q.v, i.v), 9) DESC, i.position) <= {K})
SELECT count(DISTINCT query_id) AS queries, round(count(found.item_id) / {K} / count(DISTINCT query_id), 6) AS recall_at_k
FROM exact LEFT JOIN found USING (query_id, item_id)""",
)
def q_recall(spark, sf_dir):
    """Recall of the saved index against exact search, every query."""
    queries, index = _sides(spark, sf_dir)
    approximate = saved_index(spark, sf_dir).topk(queries, K, PROBED_COARSE, PROBED)
    return rounded(metrics.ann_recall(exact_topk(queries, index, K), approximate, K))


@register("ann_benchmark")
def q_sweep(spark, sf_dir):
    queries, index = _sides(spark, sf_dir)
    exact = sliced.all_hits(spark, sf_dir).filter("store = 'full'")
    scorable = queries.join(exact.select("query_id").distinct(), "query_id", "left_semi")
    return ann.sweep(scorable, index, exact, K, CELLS, (1, 4, 16))


@register("expand_corpus")
def q_expand(spark, sf_dir):
    """Four times the corpus, with the cosine of every copy to its source."""
    rows = store(spark, sf_dir)
    n = rows.count()
    grown = ann.expand_corpus(rows, n, 4 * n, 64, 42, 0.01)
    norm = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x * x)
    return grown.select("position", F.round(norm, 6).alias("norm"), F.round(F.element_at("embedding", 1), 6).alias("first"))


def expanded_sides(spark, sf_dir):
    """Queries and index of the store at twenty-five times its size, every fifth vector a query."""
    def build():
        rows = store(spark, sf_dir)
        n = rows.count()
        return ann.expand_corpus(rows, n, 25 * n, 64, 42, 0.01)

    grown = written(spark, "expanded", build).withColumn("item_id", F.col("position").cast("string"))
    queries = grown.filter("position % 5 = 0").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = grown.filter("position % 5 <> 0").select(
        "item_id", "position", F.lit(None).cast("string").alias("item_label"), F.col("embedding").alias("vector"))
    return queries, index


@register("exact_topk_expanded")
def q_topk_expanded(spark, sf_dir):
    """Exact search over the expanded corpus."""
    hits = exact_topk(*expanded_sides(spark, sf_dir), K)
    return rounded(hits.select("query_id", F.col("rank").cast("int").alias("rank"), "item_id", "score"))


# ---- streaming --------------------------------------------------------------

def _stream(spark, sf_dir, name):
    """A given table, one file or a folder of files, as a stream."""
    table, file = read(spark, sf_dir, name), f"{name}.parquet"
    if all(path.endswith(f"/{file}") for path in table.inputFiles()):  # a stream reads folders only
        return jobs.read_parquet_stream(spark, sf_dir, table.schema, file)
    return jobs.read_parquet_stream(spark, f"{sf_dir}/{file}", table.schema)


FILES = 4


def _in_files(spark, sf_dir, name, by):
    """A table as a stream of ``FILES`` batches, dealt by hash so that keys meet across batches.

    A task reads and writes a split of the table, and the rows of each batch in it are a
    file, so no task takes in a whole batch.
    """
    folder = scratch_path(spark, f"{name}-files")
    table = read(spark, sf_dir, name)
    batch = F.pmod(F.xxhash64(by), F.lit(FILES)).alias("batch")
    table.select("*", batch).write.partitionBy("batch").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    schema = T.StructType([*table.schema.fields, T.StructField("batch", T.IntegerType())])
    stream = jobs.read_parquet_stream(spark, folder, schema, files_per_batch=math.ceil(files / FILES))
    return stream.drop("batch")


def _run(spark, name, start):
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    jobs.drain(start(path, checkpoint))
    return path


@register("stream_topk", _UNIT + """, r AS (SELECT CAST(s.vec_id AS VARCHAR) AS query_id, i.item_id, CAST(row_number() OVER (PARTITION BY s.vec_id ORDER BY round(list_dot_product(q.v, i.v), 9) DESC, i.position) AS INTEGER) AS rank
  FROM embeddings s JOIN unit q ON q.position = s.vec_id, unit i WHERE i.split = 'index')
SELECT query_id, item_id, rank FROM r WHERE rank <= 10""")
def q_stream_topk(spark, sf_dir):
    arriving = _stream(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    index = metrics.index_side(store(spark, sf_dir))
    path = _run(spark, "stream-topk", lambda p, c: jobs.score_stream(arriving, index, K, p, c))
    return spark.read.parquet(path).select("query_id", "item_id", F.col("rank").cast("int").alias("rank"))


@register(
    "stream_day_dedupe",
    """SELECT user_id AS place_id, CAST(ts AS DATE) AS acquisition_day, event_id AS item_id, value AS cloud, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS items_that_day
FROM (SELECT * REPLACE (CASE WHEN event_id % 41 = 0 THEN NULL ELSE round(value, 2) END AS value) FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY coalesce(value, 1e300), ts, event_id) = 1""",
)
def q_stream_dedupe(spark, sf_dir):
    arriving = _in_files(spark, sf_dir, "events", "event_id").select(
        F.col("user_id").alias("place_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("item_id"),
        F.when(F.col("event_id") % 41 != 0, F.round("value", 2)).alias("cloud"),
    )
    path = _run(spark, "stream-days", lambda p, c: jobs.start_batches(jobs.day_dedupe_stream(arriving, late_after=None), p, c, mode="update"))
    return jobs.latest(path, spark, ["place_id", "acquisition_day"]).drop("ts")


@register("stream_ingest", "SELECT sha256(text) AS sha256, min(doc_id) AS item_id FROM documents GROUP BY sha256(text)")
def q_stream_ingest(spark, sf_dir):
    arriving = _in_files(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("item_id"), F.encode("text", "utf-8").alias("content"))
    path = _run(spark, "stream-ingest", lambda p, c: jobs.ingest_stream(arriving, p, c))
    return jobs.latest(path, spark, ["sha256"])


@register(
    "stream_metrics",
    with_sql(SQL_STORE, sql_hits()) + """SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (CAST(query_id AS BIGINT) // 40) AS window_start, round(avg(relevant), 6) AS precision_at_k, count(*) AS hits FROM hits GROUP BY 1""",
)
def q_stream_metrics(spark, sf_dir):
    """Hits arriving over time: forty items an hour."""
    folder = scratch_path(spark, "hit-stream")
    sliced.all_hits(spark, sf_dir).filter("store = 'full'").select(
        "query_id", "relevant",
        F.timestamp_seconds(F.lit(1704067200) + F.col("query_id").cast("bigint") * 90).alias("ts"),
    ).write.parquet(folder)
    arriving = jobs.read_parquet_stream(spark, folder, spark.read.parquet(folder).schema)
    path = _run(spark, "stream-metrics", lambda p, c: jobs.start_batches(jobs.precision_monitor(arriving), p, c, mode="update"))
    return rounded(jobs.latest(path, spark, ["window_start"]))
