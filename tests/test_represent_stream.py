import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrank.operators import represent
from orbitrank.streaming import jobs


def rows(spark, x, query_every=5):
    data = [(f"i{i}", "query" if i % query_every == 0 else "index", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(data, "item_id string, split string, vector array<double>")


@pytest.mark.parametrize("wide", [False, True])
def test_pca_spans_the_same_space_as_svd(spark, monkeypatch, wide):
    if wide:
        monkeypatch.setattr(represent, "COVARIANCE_FEATURES", 4)
    x = np.random.default_rng(0).normal(size=(80, 6)) * [5, 4, 3, 1, 0.5, 0.1] + 7
    index = np.array([i % 5 != 0 for i in range(80)])
    basis = represent.fit_pca(rows(spark, x), 3)
    centred = x[index] - x[index].mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(basis.mean, x[index].mean(axis=0))
    assert np.allclose(np.abs((basis.components * v[:3]).sum(axis=1)), 1, atol=1e-6)
    assert np.allclose(basis.explained, (s**2 / (s**2).sum())[:3])
    got = {r["item_id"]: np.array(r["embedding"]) for r in represent.project(rows(spark, x), basis).collect()}
    want = (x - basis.mean) @ basis.components.T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(np.stack([got[f"i{i}"] for i in range(80)]), want)
    with pytest.raises(ValueError):
        represent.fit_pca(rows(spark, x), 7)


def test_encoder_output_is_checked(spark):
    df = spark.createDataFrame([("a", "xy"), ("b", "")], "item_id string, text string")
    good = lambda: lambda texts: np.array([[len(t) + 1.0, 1.0] for t in texts])
    assert all(abs(sum(v * v for v in r["embedding"]) - 1) < 1e-12 for r in represent.encode(df, "text", good, 2).collect())
    zero = lambda: lambda texts: np.zeros((len(texts), 2))
    with pytest.raises(Exception, match="zero-length"):
        represent.encode(df, "text", zero, 2).collect()
    with pytest.raises(Exception, match="expected"):
        represent.encode(df, "text", good, 3).collect()


def test_backends_that_cannot_embed_new_items(spark):
    items = spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")
    for backend, message in (("terramind", "archive members"), ("pca", "fitted projection"), (None, "not supported")):
        meta = spark.createDataFrame([("s", backend, 1)], "store string, backend string, dimension int")
        with pytest.raises(ValueError, match=message):
            represent.query_new_items(items, None, meta, 1)


EVENTS = "place_id string, ts timestamp, cloud double, item_id string"


def test_day_dedupe_over_batches_drops_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    at = lambda d, h=10: dt.datetime(2024, 6, d, h)
    batches = [
        [("p", at(1), 8.0, "a"), ("p", at(1, 11), None, "b")],
        [("p", at(1, 12), 2.0, "c"), ("p", at(9), 1.0, "d")],
        [("p", at(1, 13), 0.0, "late"), ("p", at(9, 12), 0.5, "e")],
    ]
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = jobs.read_parquet_stream(spark, str(folder), spark.createDataFrame([], EVENTS).schema, files_per_batch=1)
        query = jobs.start_batches(jobs.day_dedupe_stream(stream, "2 days"), str(tmp_path / "out"), str(tmp_path / "state"), mode="update")
        jobs.drain(query)
    got = {(str(r["acquisition_day"]), r["item_id"]) for r in jobs.latest(str(tmp_path / "out"), spark, ["place_id", "acquisition_day"]).collect()}
    assert got == {("2024-06-01", "c"), ("2024-06-09", "e")}


def test_ingest_remembers_every_batch(spark, tmp_path):
    folder, schema = tmp_path / "in", "item_id string, content binary"
    for batch in ([("a", b"x"), ("b", b"x"), ("c", b"y")], [("d", b"y"), ("e", b"z")], [("f", b"x"), ("g", b"w")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = jobs.read_parquet_stream(spark, str(folder), spark.createDataFrame([], schema).schema)
        jobs.drain(jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")))
    kept = jobs.latest(str(tmp_path / "out"), spark, ["sha256"]).collect()
    assert sorted(r["item_id"] for r in kept) == ["a", "c", "e", "g"]


def test_a_lower_id_of_a_later_batch_wins(spark, tmp_path):
    folder, schema = tmp_path / "in", "item_id string, content binary"
    for batch in ([("m", b"x"), ("b", b"y")], [("a", b"x"), ("z", b"y")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = jobs.read_parquet_stream(spark, str(folder), spark.createDataFrame([], schema).schema, files_per_batch=1)
    jobs.drain(jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")))
    assert sorted(r["item_id"] for r in jobs.latest(str(tmp_path / "out"), spark, ["sha256"]).collect()) == ["a", "b"]


def test_without_a_late_policy_every_row_counts(spark, tmp_path):
    folder = tmp_path / "in"
    for day, cloud, item in ((9, 5.0, "a"), (1, 9.0, "b"), (9, 1.0, "c"), (1, 2.0, "d")):
        row = [("p", dt.datetime(2024, 6, day), cloud, item)]
        spark.createDataFrame(row, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    stream = jobs.read_parquet_stream(spark, str(folder), spark.createDataFrame([], EVENTS).schema, files_per_batch=1)
    jobs.drain(jobs.start_batches(jobs.day_dedupe_stream(stream, None), str(tmp_path / "out"), str(tmp_path / "state"), mode="update"))
    got = jobs.latest(str(tmp_path / "out"), spark, ["place_id", "acquisition_day"]).collect()
    assert {(r["acquisition_day"].day, r["item_id"], r["items_that_day"]) for r in got} == {(1, "d", 2), (9, "c", 2)}


def test_repeats_within_the_watermark(spark, tmp_path):
    schema = "sha256 string, ts timestamp"
    spark.createDataFrame([("h", dt.datetime(2024, 1, 1)), ("h", dt.datetime(2024, 1, 1, 1)), ("k", dt.datetime(2024, 1, 2))], schema).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_parquet_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    jobs.drain(jobs.start_batches(jobs.unique_within_watermark(stream), str(tmp_path / "out"), str(tmp_path / "state")))
    assert sorted(r["sha256"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["h", "k"]
