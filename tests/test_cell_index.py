"""The saved approximate index: what it holds, what it reads, and how much it finds."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrank.operators import ann, cell_index, metrics
from orbitrank.operators.topk import exact_topk

INDEX = "item_id string, position bigint, item_label string, vector array<double>"


def _index(spark, rows):
    return spark.createDataFrame([(f"i{n:05d}", n, None, [float(x) for x in v]) for n, v in enumerate(rows)], INDEX)


def _queries(spark, rows):
    return spark.createDataFrame([(f"q{n}", [float(x) for x in v]) for n, v in enumerate(rows)], "query_id string, vector array<double>")


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(12, 8))
    return np.concatenate([m + 0.3 * draw.normal(size=(60, 8)) for m in middle] + [middle[:1].repeat(50, axis=0)])


def test_all_cells_give_the_exact_answer(spark, vectors, tmp_path):
    index, queries = _index(spark, vectors), _queries(spark, vectors[::37] + 0.01)
    cell_index.save_index(index, str(tmp_path / "a"), 5, 4)
    saved = cell_index.load_index(spark, str(tmp_path / "a"))
    assert saved.vectors.count() == len(vectors)
    exact = {tuple(r) for r in exact_topk(queries, index, 7).select("query_id", "rank", "item_id").collect()}
    found = saved.topk(queries, 7, 5, saved.centres.cells).select("query_id", "rank", "item_id")
    assert {tuple(r) for r in found.collect()} == exact


def test_every_row_lies_at_its_nearest_centre(spark, vectors, tmp_path):
    cell_index.save_index(_index(spark, vectors), str(tmp_path / "b"), 6, 3)
    saved = cell_index.load_index(spark, str(tmp_path / "b"))
    for row in saved.vectors.collect():
        v = np.array(row["vector"]) / np.linalg.norm(row["vector"])
        coarse = int(np.round(saved.centres.coarse @ v, 9).argmax())
        fine = int(np.round(saved.centres.fine[coarse] @ v, 9).argmax())
        assert row["cell"] == coarse * 3 + fine


def test_only_probed_cells_are_read(spark, vectors, tmp_path):
    cell_index.save_index(_index(spark, vectors), str(tmp_path / "c"), 6, 3)
    saved = cell_index.load_index(spark, str(tmp_path / "c"))
    hits = saved.topk(_queries(spark, vectors[:1]), 5, 2, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ as bigint\) IN \(|PartitionFilters: \[[^\]]*cell", plan)
    assert hits.count() == 5
    probed = {r["cell"] for r in saved.probe(_queries(spark, vectors[:1]), 2, 3).collect()}
    ids = {r["item_id"] for r in saved.vectors.where(F.col("cell").isin(*probed)).collect()}
    assert {r["item_id"] for r in hits.collect()} <= ids and len(probed) == 3


def test_small_and_refused(spark, vectors, tmp_path, monkeypatch):
    cell_index.save_index(_index(spark, vectors[:2]), str(tmp_path / "d"), 6, 3)
    saved = cell_index.load_index(spark, str(tmp_path / "d"))
    assert saved.topk(_queries(spark, vectors[:3]), 5, 9, 99).count() == 6
    assert saved.topk(_queries(spark, vectors[:1]).limit(0), 5, 1, 1).count() == 0
    with pytest.raises(ValueError, match="at least one vector"):
        cell_index.save_index(_index(spark, vectors[:1]).limit(0), str(tmp_path / "e"), 2, 2)
    monkeypatch.setattr(cell_index, "CENTRE_BYTES", 100)
    with pytest.raises(ValueError, match="bytes together"):
        cell_index.save_index(_index(spark, vectors), str(tmp_path / "f"), 5, 4)


def test_recall_at_forty_thousand_rows(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    base = table.select(F.col("vec_id").alias("position"), "embedding")
    n = base.count()
    grown = ann.expand_corpus(base, n, 40_000, 64, 42, 0.01)
    index = grown.select(F.col("position").cast("string").alias("item_id"), "position", F.lit(None).cast("string").alias("item_label"),
                         F.col("embedding").alias("vector")).where("position % 97 <> 7")
    queries = grown.where("position % 97 = 7").select(F.col("position").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    cell_index.save_index(index, str(tmp_path / "g"), 32, 16)
    saved = cell_index.load_index(spark, str(tmp_path / "g"))
    found = saved.topk(queries, 10, 8, 24)  # 24 of 512 cells
    got = metrics.ann_recall(exact_topk(queries, index, 10), found, 10).first()
    print("recall", got)
    assert got["queries"] == 413 and got["recall_at_k"] >= 0.9
