"""Registered queries on tables unlike the given ones: copies across labels, tables in folders."""

import shutil

import pytest
from oracle_compare import compare, connect
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from conftest import SF_DIR

MANIFEST_QUERIES = (
    "scan_images", "manifest_write", "manifest_read", "manifest_violations", "run_metadata", "sample_per_group",
    "verify_files",
)


@pytest.fixture(scope="module")
def two_languages(spark, tmp_path_factory):
    """Documents of which some texts come in two languages, without a language, or not at all."""
    folder = tmp_path_factory.mktemp("languages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    n = docs.count()
    again = docs.where("doc_id % 9 = 0").withColumns({
        "doc_id": F.col("doc_id") + n,
        "lang": F.when(F.col("doc_id") % 4 == 0, None).when(F.col("lang") == "de", "en").otherwise("de"),
        "text": F.when(F.col("doc_id") % 7 != 0, F.col("text")),
    })
    docs.unionByName(again).toPandas().to_parquet(folder / "documents.parquet", index=False)
    return str(folder)


@pytest.mark.parametrize("name", MANIFEST_QUERIES)
def test_manifest_queries_list_copies_across_labels_instead_of_refusing(spark, two_languages, name):
    assert compare(queries()[name](spark, two_languages), oracle_sql()[name], connect(two_languages)) is None


@pytest.fixture(scope="module")
def odd_ids(spark, tmp_path_factory):
    """Documents of which some have ids below zero, of ten digits, or none."""
    folder = tmp_path_factory.mktemp("ids")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    d = F.col("doc_id")
    for rows, moved in ((d % 3 == 0, d + 3_000_000_000), (d % 5 == 0, -d - 1), (d % 50 == 0, F.lit(None).cast("bigint"))):
        more = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(rows)
        docs = docs.unionByName(more.withColumns({"text": F.concat("text", moved.isNull().cast("string"), F.lit(" "), (d % 7).cast("string")), "doc_id": moved}))
    docs.write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["manifest_violations", "run_metadata", "sample_per_group"])
def test_manifest_queries_take_every_id(spark, odd_ids, name):
    con = connect(str(odd_ids) + "/none")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd_ids}/documents.parquet/*.parquet'")
    assert compare(queries()[name](spark, odd_ids), oracle_sql()[name], con) is None


def test_stream_topk_reads_a_table_in_a_folder_of_files(spark, tmp_path):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").where("vec_id < 120")
    table.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries()["stream_topk"](spark, str(tmp_path))
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare(found, oracle_sql()["stream_topk"], con) is None


@pytest.mark.parametrize("name", ["analyze", "report_json"])
def test_the_analysis_ranks_each_store_once(spark, sf_dir, monkeypatch, name):
    """Ranking is what an analysis costs: scores, slices and quartiles read one hits table."""
    from orbitrank.plans import slices

    ranked, placed = [], []
    ranking, geography = slices.metrics.ranked_hits, slices.slices.query_geography
    monkeypatch.setattr(slices.metrics, "ranked_hits", lambda *a: ranked.append(a) or ranking(*a))
    monkeypatch.setattr(slices.slices, "query_geography", lambda *a: placed.append(a) or geography(*a))
    queries()[name](spark, sf_dir)
    assert (len(ranked), len(placed)) == (3, 1)


def test_streamed_tables_are_cut_into_splits_not_into_one_file_a_batch(spark, tmp_path):
    """Four tasks that write a batch each would each read a quarter of the table, however large."""
    from orbitrank.plans import jobs

    table = spark.range(400).repartition(9)
    table.write.parquet(str(tmp_path / "things.parquet"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each file
    try:
        stream = jobs._in_files(spark, str(tmp_path), "things", "id").select("id", F.input_file_name().alias("file"))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    path = jobs._run(spark, "things", lambda p, c: jobs.jobs.start_batches(stream, p, c))
    rows = spark.read.parquet(path)
    batches = rows.groupBy("batch_id").count().collect()
    assert sum(r["count"] for r in batches) == 400 and len(batches) == jobs.FILES
    # A batch is many files: its rows come from one for each split.
    assert rows.select("batch_id", "file").distinct().count() > jobs.FILES * 4


def test_band_geometry_sorts_no_headers(spark, sf_dir):
    """Twelve headers a patch meet one footprint: the footprints are hashed, the headers stream."""
    plan = queries()["band_geometry"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan
