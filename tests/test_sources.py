import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrank.operators import checks, represent
from orbitrank.sources import catalogue, manifests, patches, reports, stores


def png(path, pixels):
    """Write an RGB array as PNG."""
    height, width, _ = pixels.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels.astype(np.uint8))
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    for name in ("forest/a.png", "forest/b.PNG", "forest/deep/c.png", "river/d.png", "river/e.png", "root.png"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        png(target, rng.integers(0, 255, (12, 10, 3)))
    (tmp_path / "forest" / "copy.png").write_bytes((tmp_path / "forest" / "a.png").read_bytes())
    (tmp_path / "notes.txt").write_text("not an image")
    return tmp_path


def test_folder_scan(spark, folder):
    files = manifests.read_image_files(spark, str(folder))
    rows = {r["item_id"]: r for r in manifests.build_manifest(files, str(folder), seed=1).collect()}
    assert set(rows) == {"forest/a.png", "forest/b.PNG", "forest/copy.png", "forest/deep/c.png", "river/d.png", "river/e.png", "root.png"}
    assert rows["root.png"]["label"] is None and rows["forest/deep/c.png"]["label"] == "forest"
    assert rows["forest/a.png"]["split"] == rows["forest/copy.png"]["split"]
    (folder / "river" / "copy.png").write_bytes((folder / "forest" / "a.png").read_bytes())
    with pytest.raises(ValueError, match="content_has_two_labels"):
        manifests.build_manifest(manifests.read_image_files(spark, str(folder)), str(folder))


def test_manifest_round_trip_and_bad_lines(spark, tmp_path, folder):
    files = manifests.read_image_files(spark, str(folder))
    built = manifests.build_manifest(files, str(folder))
    shaped = built.select("item_id", "path", "split", "label", "source", F.create_map(F.lit("sha256"), "sha256").alias("metadata"))
    out = str(tmp_path / "out")
    manifests.write_manifest(shaped, out)
    good, broken = manifests.read_manifest(spark, out)
    assert broken.count() == 0
    assert good.select("item_id", "label", "split", "sha256").exceptAll(built.select("item_id", "label", "split", "sha256")).count() == 0
    (tmp_path / "bad.json").write_text('{"item_id": "a", "path": "a", "split": "index"}\n\n{"item_id": \n{"item_id": "b"}\n')
    good, broken = manifests.read_manifest(spark, str(tmp_path / "bad.json"))
    assert good.count() == 1
    assert sorted(map(tuple, broken.collect())) == [("missing_field", "bad.json:4"), ("unreadable_line", "bad.json:3")]
    with pytest.raises(ValueError, match="bad.json:[34]"):
        manifests.load_manifest(spark, str(tmp_path / "bad.json"))


def test_loading_refuses_what_is_not_whole(spark, tmp_path):
    def load(name, text):
        (tmp_path / name).write_text(text)
        return manifests.load_manifest(spark, str(tmp_path / name))

    row = '{"item_id": "%s", "path": "%s", "split": "%s", "label": "x", "metadata": {"sha256": "%s"}}\n'
    assert load("good.json", row % ("a", "a", "index", "h") + row % ("b", "b", "query", "k")).count() == 2
    for name, text, message in (
        ("empty.json", "\n  \n", "manifest is empty"), ("nothing.json", "", "manifest is empty"),
        ("twice.json", row % ("a", "a", "index", "h") * 2, "duplicate_item_id: a"),
        ("split.json", row % ("a", "a", "held", "h"), "unknown_split: a"),
        ("leak.json", row % ("a", "a", "index", "h") + row % ("b", "b", "query", "h"), "content_in_two_splits: h"),
        ("text.json", row % ("a", "a", "index", "h") + "plain text\n", "unreadable_line: text.json:2"),
        ("lists.json", row % ("a", "a", "index", "h") + "7\n", "json:2"),
    ):
        with pytest.raises(ValueError, match=message):
            load(name, text)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from orbitrank.sources.lines import numbered_lines

    rng = __import__("random").Random(1)
    texts = {}
    for name, n in (("a.txt", 1), ("b.txt", 3_000), ("c.txt", 0), ("d.txt", 700)):
        texts[name] = ["x" * rng.choice([0, 1, 5, 400]) + str(i) * rng.randint(0, 1) for i in range(n)]
        (tmp_path / name).write_text("".join(f"{x}\n" for x in texts[name]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = numbered_lines(spark, str(tmp_path))
        assert lines.select("value").rdd.getNumPartitions() > 0
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, i): x for name, own in texts.items() for i, x in enumerate(own, 1)}


def test_merkle_trees(spark):
    import hashlib

    from orbitrank.sources import trees

    files = [(f"/t/{i % 5}/f{i}", f"content {i % 11}".encode()) for i in range(300)] + [
        ("/t/.git/x", b"1"), ("/t/a/.git/y", b"2"), ("/t/empty", b"")
    ]
    schema = "path string, content binary"
    entries = trees.tree_entries(spark.createDataFrame(files, schema).repartition(7), "/t", [".git"])
    assert entries.count() == 301
    root = trees.merkle_digest(entries, 2).first()
    turned = trees.tree_entries(spark.createDataFrame(files[::-1], schema), "/t/", [".git"])
    assert trees.merkle_digest(turned, 2).first() == root and root["files"] == 301
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = {}
    for path, content in files[:300] + files[-1:]:
        inside = path[3:]
        line = f"{sha(inside)}|{inside}|{len(content)}|{hashlib.sha256(content).hexdigest()}"
        leaves.setdefault(sha(inside)[:2], []).append(line)
    level = {k: sha("\n".join(sorted(v))) for k, v in leaves.items()}
    for digits in (1, 0):
        above = {}
        for prefix in sorted(level):
            above.setdefault(prefix[:digits], []).append(f"{prefix}|{level[prefix]}")
        level = {k: sha("\n".join(sorted(v))) for k, v in above.items()}
    assert level[""] == root["digest"]
    renamed = [(p.replace("f17", "g17"), c) for p, c in files]
    other = trees.tree_entries(spark.createDataFrame(renamed, schema), "/t", [".git"])
    changed = trees.merkle_differences(trees.merkle_nodes(entries, 2), trees.merkle_nodes(other, 2))
    moved = {sha(x[3:])[:2] for (x, _), (y, _) in zip(files, renamed) if x != y} | {
        sha(y[3:])[:2] for (x, _), (y, _) in zip(files, renamed) if x != y}
    assert {r[0] for r in changed.collect()} == moved
    assert trees.merkle_digest(entries.limit(0)).count() == 0


def test_file_verification(spark, folder):
    built = manifests.build_manifest(manifests.read_image_files(spark, str(folder)), str(folder))
    built = spark.createDataFrame(built.collect(), built.schema)
    png(folder / "river" / "d.png", np.zeros((4, 4, 3)))
    (folder / "root.png").unlink()
    now = manifests.read_image_files(spark, str(folder)).select(F.expr(f"substring(path, instr(path, '{folder}/') + {len(str(folder)) + 1})").alias("path"), "content")
    assert {(r["rule"], r["key"]) for r in checks.verify_files(built, now).collect()} == {("checksum_mismatch", "river/d.png"), ("missing_file", "root.png")}


def test_images_flatten_to_unit_interval(spark, folder):
    solid = folder / "solid"
    solid.mkdir()
    png(solid / "s.png", np.full((20, 30, 3), (10, 100, 200)))
    png(solid / "t.png", np.random.default_rng(1).integers(0, 255, (8, 8, 3)))
    images = spark.read.format("image").load(str(solid)).select(
        F.element_at(F.split("image.origin", "/"), -1).alias("item_id"), "image.height", "image.width", "image.nChannels", "image.data")
    rows = {r["item_id"]: np.array(r["pixels"]) for r in represent.flatten_images(images, 8).collect()}
    assert rows["s.png"].shape == (192,)
    assert np.allclose(rows["s.png"].reshape(-1, 3), np.array([10, 100, 200]) / 255)
    original = np.random.default_rng(1).integers(0, 255, (8, 8, 3))
    assert np.allclose(rows["t.png"].reshape(8, 8, 3), original / 255)
    with pytest.raises(ValueError):
        represent.flatten_images(images, 4)


def test_store_round_trip_keeps_null_labels(spark, tmp_path):
    rows = [(0, "a", [1.0, 2.0], None, "index"), (1, "b", [3.0, 4.0], "", "query"), (2, "c", [0.5, 0.5], "x", "index")]
    df = spark.createDataFrame(rows, "position bigint, item_id string, embedding array<float>, label string, split string")
    stores.save_store(df, str(tmp_path / "s"), {"store": "one", "backend": "pca", "manifest_sha256": "ab", "extra": "1"})
    back, meta = stores.load_store(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in back.orderBy("position").collect()] == [tuple(r) for r in df.collect()]
    assert meta.first()["backend"] == "pca" and meta.first()["metadata"] == {"extra": "1"}
    assert [r["label"] for r in stores.legacy_labels(back).orderBy("position").collect()] == [None, None, "x"]
    odd = df.unionByName(spark.createDataFrame([(3, "c", [1.0], "x", "holdout")], df.schema))
    assert {r["rule"] for r in stores.store_violations(odd).collect()} == {"mixed_dimensions", "duplicate_item_id", "unknown_split"}


def test_relevance_document(spark, tmp_path):
    path = tmp_path / "rel.json"
    path.write_text(json.dumps({"schema": stores.RELEVANCE_TAG, "dataset": "d", "image_manifest_sha256": "h", "records": [
        {"item_id": "i", "labels": ["a"], "partition": "index"}, {"item_id": "q", "labels": [], "partition": "final"},
        {"item_id": "bad", "labels": [], "partition": "index"}]}, indent=1))
    header, rows = stores.read_relevance(spark, str(path))
    assert header.first()["dataset"] == "d" and rows.count() == 3
    assert [(r["rule"], r["key"]) for r in stores.relevance_record_violations(rows).collect()] == [("unlabeled_index_item", "bad")]


def test_url_rules(spark):
    urls = ["https://ok.example.org/api", "http://plain.example.org", "https://u:p@host.example.org", "https://h.example.org/?a=1",
            "https://h.example.org/#f", "not a url"]
    df = spark.createDataFrame([(u, u) for u in urls], "id string, url string")
    found = {}
    for r in checks.url_violations(df, "id").collect():
        found.setdefault(r["key"], set()).add(r["rule"])
    assert "https://ok.example.org/api" not in found
    assert found["http://plain.example.org"] == {"not_https"} and "has_userinfo" in found["https://u:p@host.example.org"]
    assert found["https://h.example.org/?a=1"] == {"has_query"} and found["https://h.example.org/#f"] == {"has_fragment"}
    assert "not_https" in found["not a url"]


def test_path_rules(spark):
    bad = {"C:/a.png", "\\\\host\\share", "/etc/x", "a/../b", "..\\x"}
    df = spark.createDataFrame([(p,) for p in [*bad, "ok/a.png", "a..b.png"]], "path string")
    assert {r["key"] for r in checks.path_violations(df, "path").collect()} == bad


def test_catalogue_refuses_addresses(spark, tmp_path):
    import datetime as dt

    row = ("https://c.example.org", "s2", "i1", [1.0, 2.0, 3.0, 4.0], dt.datetime(2024, 1, 1), ["B02"], {"platform": "x", "eo:cloud_cover": "5"})
    items = spark.createDataFrame([row], catalogue.ITEM_SCHEMA)
    catalogue.write_items(items, str(tmp_path / "ok"))
    back, broken = catalogue.read_items(spark, str(tmp_path / "ok"))
    assert broken.count() == 0 and back.first()["item_id"] == "i1"
    leaking = items.withColumn("properties", F.create_map(F.lit("aHREF"), F.lit("x")))
    with pytest.raises(ValueError, match="contains_href"):
        catalogue.write_items(leaking, str(tmp_path / "no"))
    wanted = catalogue.Search("s2", 0, 0, 2, 3, "2023-01-01", "2025-01-01", 5, 5.0)
    assert catalogue.search(items, wanted).count() == 0  # strict ceiling
    wanted = catalogue.Search("s2", 0, 0, 2, 3, "2023-01-01", "2025-01-01", 5, 6.0)
    assert catalogue.search(items, wanted).count() == 1
    times = [dt.datetime(2024, 5, 3, h) for h in (0, 10, 23)] + [dt.datetime(2024, 5, 4), dt.datetime(2024, 5, 2, 23)]
    many = spark.createDataFrame([(*row[:2], f"i{i}", row[3], t, *row[5:]) for i, t in enumerate(times)], catalogue.ITEM_SCHEMA)
    for end, found in (("2024-05-03", 3), ("2024-05-03 10:00:00", 2), ("2024-05-04", 4)):
        dated = catalogue.Search("s2", 0, 0, 2, 3, "2024-05-03", end, 5)
        assert catalogue.search(many, dated).count() == found
    with pytest.raises(ValueError):
        catalogue.Search("s2", 5, 0, 2, 3, "a", "b")


def test_patch_ids_and_columns(spark, tmp_path):
    df = spark.createDataFrame([("S2A_MSIL2A_20170613T101031_N9999_R022_T33UUP_26_57",), ("S2A_MSIL2A_20171340T101031_N9999_R022_T33UUP_26_57",), ("x",)], "patch_id string")
    rows = df.select(*[c.alias(n) for n, c in patches.parse_patch_id(F.col("patch_id")).items()]).collect()
    assert (str(rows[0]["acquisition_day"]), rows[0]["tile"], rows[0]["row"], rows[0]["column"], rows[0]["grid"]) == ("2017-06-13", "33UUP", 26, 57, "33UUP_26_57")
    assert rows[1]["acquisition_day"] is None and rows[2]["tile"] is None
    df.write.parquet(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="lacks required columns"):
        patches.read_metadata(spark, str(tmp_path / "m"))


def test_report_needs_every_section(spark):
    docs = spark.createDataFrame([('{"k": 1, "aggregate": {}}',)], "value string")
    with pytest.raises(Exception, match="report lacks: agreement, geographic, distance, failures"):
        reports.read_report(docs).collect()
    names = spark.createDataFrame([("po-valley-cremona",), ("crete",), ("a-b",)], "p string")
    assert [r[0] for r in names.select(reports.place_label(F.col("p"))).collect()] == ["Po valley", "Crete", "A"]


def test_run_parameters_are_allow_listed(spark):
    meta = spark.createDataFrame(
        [("s", "weird", "m", "AB" * 32, None, {"checkpoint_sha256": "short", "secret": "x"})], stores.META_SCHEMA)
    row = reports.evaluation_parameters(meta).first()
    assert (row["backend"], row["manifest_sha256"], row["checkpoint_sha256"]) == ("custom", "ab" * 32, None)
    assert "secret" not in row.asDict()
