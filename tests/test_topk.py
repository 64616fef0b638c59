import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrank.operators import metrics, topk
from orbitrank.operators.ann import CellIndex, cell_topk, expand_corpus, hyperplane_topk


def sides(spark, rng, n_query=40, n_index=300, d=8, copies=True):
    index = rng.normal(size=(n_index, d))
    if copies:
        index[n_index // 3 :: 3] = index[0]
    queries = rng.normal(size=(n_query, d))
    left = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vector array<double>")
    right = spark.createDataFrame(
        [(f"i{i}", i, f"l{i % 3}", v.tolist()) for i, v in enumerate(index)],
        "item_id string, position bigint, item_label string, vector array<double>",
    )
    return left, right, queries, index


def brute(queries, index, k):
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    x = index / np.linalg.norm(index, axis=1, keepdims=True)
    scores = np.round(q @ x.T, topk.SCORE_DIGITS)
    return {f"q{i}": [f"i{j}" for j in np.lexsort((np.arange(len(x)), -row))[:k]] for i, row in enumerate(scores)}


def as_lists(hits):
    out = {}
    for row in hits.orderBy("query_id", "rank").collect():
        out.setdefault(row["query_id"], []).append(row["item_id"])
    return out


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_exact_with_copies_and_any_partitioning(spark, parts):
    left, right, q, x = sides(spark, np.random.default_rng(1))
    assert as_lists(topk.exact_topk(left, right.repartition(parts), 7)) == brute(q, x, 7)


def test_grid_equals_shipped(spark):
    left, right, q, x = sides(spark, np.random.default_rng(2))
    grid = topk.grid_topk(left, right, 40, 300, 5, chunk_rows=16)
    assert as_lists(grid) == brute(q, x, 5)
    forced = topk.exact_topk(left, right, 5, shipped_bytes=0)
    assert as_lists(forced) == brute(q, x, 5)


def test_fewer_rows_than_k_and_self_exclusion(spark):
    left = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, vector array<double>")
    right = spark.createDataFrame(
        [("a", 0, "x", [1.0, 0.0]), ("b", 1, None, [0.0, 1.0])],
        "item_id string, position bigint, item_label string, vector array<double>",
    )
    assert as_lists(topk.exact_topk(left, right, 5)) == {"a": ["b"]}
    assert as_lists(topk.exact_topk(left, right, 5, exclude_self=False)) == {"a": ["a", "b"]}
    with pytest.raises(ValueError):
        topk.exact_topk(left, right, 0)
    with pytest.raises(ValueError, match="distinct"):
        topk.exact_topk(left.unionByName(left), right, 1)


def test_plan_limits_before_the_shuffle(spark):
    left, right, _, _ = sides(spark, np.random.default_rng(3))
    plan = topk.exact_topk(left, right, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_inverted_cells_with_one_crowded_cell(spark):
    left, right, q, x = sides(spark, np.random.default_rng(4), n_index=400)
    cells = CellIndex(right, 6)
    assert as_lists(cells.topk(left, 5, nprobe=6)) == brute(q, x, 5)
    split = cell_topk(cells.probe(left, 6), cells.index, 5, chunk_rows=10)
    assert as_lists(split) == brute(q, x, 5)
    few = cells.topk(left, 5, nprobe=1)
    assert 0 < metrics.ann_recall(cells.topk(left, 5, 6), few, 5).first()["recall_at_k"] <= 1


def test_hyperplanes_return_no_repeats(spark):
    left, right, _, _ = sides(spark, np.random.default_rng(5))
    hits = hyperplane_topk(left, right, 5, 8, bits=2, tables=3)
    assert hits.groupBy("query_id", "item_id").count().filter("count > 1").count() == 0
    assert hits.filter("rank > 5").count() == 0


def test_recall_of_known_lists(spark):
    exact = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("b", "4")], "query_id string, item_id string")
    found = spark.createDataFrame([("a", "2"), ("a", "5"), ("b", "4"), ("b", "3")], "query_id string, item_id string")
    assert metrics.ann_recall(exact, found, 2).first()["recall_at_k"] == 0.75


def test_expansion_keeps_base_and_ignores_partitioning(spark):
    base = spark.createDataFrame(
        [(i, np.random.default_rng(i).normal(size=6).tolist()) for i in range(10)], "position bigint, embedding array<double>"
    )
    grown = expand_corpus(base, 10, 35, 6, 42, 0.01).orderBy("position").collect()
    again = expand_corpus(base.repartition(5), 10, 35, 6, 42, 0.01).orderBy("position").collect()
    assert len(grown) == 35 and [r["embedding"] for r in grown] == [r["embedding"] for r in again]
    matrix = np.array([r["embedding"] for r in grown])
    assert np.allclose(np.linalg.norm(matrix, axis=1), 1)
    near = (matrix[10:20] * matrix[:10]).sum(axis=1)
    assert (near > 0.99).all() and (near < 1).all()
    with pytest.raises(ValueError):
        expand_corpus(base, 10, 5, 6, 42, 0.01)


def test_scoring_holds_slices_however_large_its_blocks_are():
    """A first block of unrelated vectors and one of ties: neither is held as a whole table of scores."""
    import tracemalloc

    rng = np.random.default_rng(3)
    unit = rng.normal(size=(16_384, 8))
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    ids = np.array([str(i) for i in range(len(unit))], dtype=object)
    running = topk._Running(list(ids[:1_024]), unit[:1_024], 10)
    tracemalloc.start()
    running.offer(unit, np.arange(len(unit)), ids, ids, exclude_self=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # 16,384 x 1,024 scores, held twice to find their k-th best, had over 200 MB


def test_grid_writes_each_vector_once(spark):
    """Blocks meet where they were written: what is shuffled before they meet is not repeated."""
    rng = np.random.default_rng(4)
    rows = [(str(i), rng.normal(size=4).tolist()) for i in range(200)]
    queries = spark.createDataFrame(rows, "query_id string, vector array<double>")
    index = queries.selectExpr("query_id AS item_id", "CAST(query_id AS BIGINT) AS position", "'x' AS item_label", "vector")
    found = topk.grid_topk(queries, index, 200, 200, 3, chunk_rows=16, part_rows=64)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Cross" in plan and "Generate" not in plan
    whole = topk.shipped_topk(queries, index, 3)
    key = lambda r: (r["query_id"], r["rank"])
    assert [r["item_id"] for r in sorted(found.collect(), key=key)] == [r["item_id"] for r in sorted(whole.collect(), key=key)]


def test_near_copies_are_met_as_one(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    index = (np.repeat(base, 20, axis=0) + 0.02 * rng.normal(size=(1_200, 16)))[rng.permutation(1_200)]
    unit = index / np.linalg.norm(index, axis=1, keepdims=True)
    order, heads, radii = topk.grouped(unit)
    assert len(heads) == 60 and sorted(order) == list(range(1_200))
    assert radii.max() < topk.GROUP_RADIUS
    scored = []
    monkeypatch.setattr(topk, "_pair_scores", lambda *x, f=topk._pair_scores: scored.append(len(x[2])) or f(*x))
    queries = base + 0.02 * rng.normal(size=base.shape)
    running = topk._Running([f"q{i}" for i in range(60)], queries / np.linalg.norm(queries, axis=1, keepdims=True), 5)
    items = np.array([f"i{i}" for i in order], dtype=object)
    for _ in range(2):  # the second time bounds are known, which rule out all other groups
        scored.clear()
        running.offer(unit[order], order, items, items, False, topk.Groups.of(heads, radii, 1_200))
    assert sum(scored) <= 60 * 20
    left = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vector array<double>")
    right = spark.createDataFrame(
        [(f"i{i}", i, None, v.tolist()) for i, v in enumerate(index)],
        "item_id string, position bigint, item_label string, vector array<double>",
    )
    assert as_lists(topk.grid_topk(left, right, 60, 1_200, 5, chunk_rows=100, part_rows=400)) == brute(queries, index, 5)
