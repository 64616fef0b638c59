"""How the engine's tables are derived from the given ones, in Spark and in SQL.

Every registered query starts from one of these. The SQL text beside each
builder is the same derivation for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitrank.functions import geo
from orbitrank.operators.splits import hash_split
from orbitrank.session import scratch_path

K = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- embedding stores -------------------------------------------------------

def base_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        position.alias("position"),
        F.lpad(position.cast("string"), 8, "0").alias("item_id"),
        position.cast("string").alias("content_key"),
        "embedding",
        F.when(position % 50 == 7, None).otherwise(F.col("label").cast("string")).alias("label"),
    )


_STORES: dict[tuple, str] = {}


def written(spark: SparkSession, name: str, build) -> DataFrame:
    """A derived table, written within the query that asks for it and read back by column."""
    path = scratch_path(spark, name)
    build().write.parquet(path)
    return spark.read.parquet(path)


def _kept_store(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A store is a saved artifact: its split is decided once for the files it is made of."""
    files = read(spark, sf_dir, "embeddings").select(
        "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
    ).distinct().collect()
    key = (spark.sparkContext.applicationId, tuple(sorted(map(str, files))))
    if key not in _STORES:
        path = scratch_path(spark, "store")
        build().write.parquet(path)
        _STORES[key] = path
    return spark.read.parquet(_STORES[key])


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store A: the given vectors, split by content hash, with some orphan labels."""
    def build() -> DataFrame:
        split = hash_split(base_items(spark, sf_dir), "content_key")
        orphan = (F.col("split") == "query") & (F.col("position") % 97 == 3)
        return split.withColumn("label", F.when(orphan, "zz").otherwise(F.col("label"))).select(
            "position", "item_id", "embedding", "label", "split"
        )

    return _kept_store(spark, sf_dir, build)


def short_vector(embedding: Column) -> Column:
    """Representation B: the first half of the dimensions."""
    return F.slice(embedding, 1, 32)


def flipped_vector(embedding: Column) -> Column:
    """Representation C: every third dimension set to zero."""
    return F.transform(
        embedding, lambda x, i: F.when(i % 3 == 2, F.lit(0.0)).otherwise(x).cast("float")
    )


def stores(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    full = store(spark, sf_dir)
    return {
        "full": full,
        "half": full.withColumn("embedding", short_vector(F.col("embedding"))),
        "sparse": full.withColumn("embedding", flipped_vector(F.col("embedding"))),
    }


SQL_STORE = """
base AS (
  SELECT vec_id AS position, lpad(CAST(vec_id AS VARCHAR), 8, '0') AS item_id,
         CAST(vec_id AS VARCHAR) AS content_key,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
         CASE WHEN vec_id % 50 = 7 THEN NULL ELSE CAST(label AS VARCHAR) END AS label
  FROM embeddings),
base_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || content_key)) AS rk,
         count(*) OVER (PARTITION BY label) AS n FROM base),
base_split AS (
  SELECT *, CASE WHEN n >= 2 AND rk <= greatest(1, least(n - 1,
         CAST(round_even(CAST(n * 0.2 AS DOUBLE), 0) AS BIGINT))) THEN 'query' ELSE 'index' END AS split
  FROM base_ranked),
store AS (
  SELECT position, item_id, e, split,
         CASE WHEN split = 'query' AND position % 97 = 3 THEN 'zz' ELSE label END AS label
  FROM base_split)"""

SQL_STORES = SQL_STORE + """,
reps AS (
  SELECT 'full' AS store, position, item_id, label, split, e FROM store
  UNION ALL SELECT 'half', position, item_id, label, split, e[1:32] FROM store
  UNION ALL SELECT 'sparse', position, item_id, label, split,
         list_transform(e, lambda x, i: CASE WHEN i % 3 = 0 THEN 0.0 ELSE x END) FROM store)"""


def sql_hits(source: str = "store", k: int = K) -> str:
    """Unit vectors, per-label totals and ranked hits of a store table in SQL."""
    tag = "'full'" if source == "store" else "store"
    return f"""
unit AS (
  SELECT {tag} AS store, position, item_id, label, split,
         list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM {source}),
totals AS (
  SELECT store, label, count(*) AS total_relevant FROM unit
  WHERE split = 'index' AND label IS NOT NULL GROUP BY store, label),
scores AS (
  SELECT q.store, q.item_id AS query_id, q.label, t.total_relevant, i.item_id,
         i.label AS item_label, i.position, round(list_dot_product(q.v, i.v), 9) AS score
  FROM unit q JOIN totals t ON q.label = t.label AND q.store = t.store
  JOIN unit i ON i.store = q.store AND i.split = 'index'
  WHERE q.split = 'query'),
hits AS (
  SELECT store, query_id, label, total_relevant, item_id, item_label, score,
         CAST(coalesce(CAST(item_label = label AS INTEGER), 0) AS INTEGER) AS relevant,
         CAST(row_number() OVER (PARTITION BY store, query_id ORDER BY score DESC, position) AS INTEGER) AS rank
  FROM scores QUALIFY rank <= {k})"""


SQL_SCORED = """
running AS (
  SELECT *, sum(relevant) OVER (PARTITION BY store, query_id ORDER BY rank) AS cum FROM hits),
grouped AS (
  SELECT store, query_id, any_value(label) AS label, any_value(total_relevant) AS total_relevant,
         count(*) AS retrieved, sum(relevant) AS found,
         sum(relevant * cum / rank) AS precision_sum, sum(relevant / log2(rank + 1)) AS dcg,
         max(CASE WHEN rank = 1 THEN relevant END) AS top_one
  FROM running GROUP BY store, query_id),
scored AS (
  SELECT store, query_id, label, found / retrieved AS precision_at_k,
         found / total_relevant AS recall_at_k,
         precision_sum / least(total_relevant, retrieved) AS average_precision_at_k,
         dcg / (SELECT sum(1 / log2(r + 1)) FROM range(1, 100000) t(r)
                WHERE r <= least(total_relevant, retrieved) AND r <= 1000) AS ndcg_at_k,
         top_one
  FROM grouped)"""


# ---- geography --------------------------------------------------------------

def lonlat(key: Column) -> tuple[Column, Column]:
    """Deterministic coordinates for an integer key."""
    return (
        F.pmod(key * 7919, F.lit(36000)) / 100.0 - 180.0,
        F.pmod(key * 4729, F.lit(14000)) / 100.0 - 70.0,
    )


def geography(items: DataFrame) -> DataFrame:
    lon, lat = lonlat(F.col("position"))
    placed = items.withColumns({"longitude": lon, "latitude": lat})
    return placed.withColumn(
        "spatial_group", geo.lonlat_cell(F.col("longitude"), F.col("latitude"), 2_000_000.0)
    )


def sql_equal_area(lon: str, lat: str) -> tuple[str, str]:
    e2 = "0.0066943799901413165"
    e = f"sqrt({e2})"
    s = f"sin(radians({lat}))"
    k0 = f"(cos(radians(30)) / sqrt(1 - {e2} * sin(radians(30)) * sin(radians(30))))"
    q = (
        f"((1 - {e2}) * ({s} / (1 - {e2} * {s} * {s}) - "
        f"ln((1 - {e} * {s}) / (1 + {e} * {s})) / (2 * {e})))"
    )
    return f"(6378137.0 * {k0} * radians({lon}))", f"(6378137.0 * {q} / (2 * {k0}))"


def sql_cell(lon: str, lat: str, size: str = "50000.0") -> str:
    x, y = sql_equal_area(lon, lat)
    return (
        f"('epsg6933:' || CAST(CAST(floor({x} / {size}) AS BIGINT) AS VARCHAR) || ':' || "
        f"CAST(CAST(floor({y} / {size}) AS BIGINT) AS VARCHAR))"
    )


def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"(2 * 6371008.8 * asin(sqrt(least(1.0, greatest(0.0, "
        f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))))"
    )


SQL_LON = "((position * 7919) % 36000) / 100.0 - 180.0"
SQL_LAT = "((position * 4729) % 14000) / 100.0 - 70.0"

SQL_GEOGRAPHY = f"""
located AS (
  SELECT *, CAST({SQL_LON} AS DOUBLE) AS longitude, CAST({SQL_LAT} AS DOUBLE) AS latitude FROM store),
placed AS (
  SELECT *, {sql_cell('longitude', 'latitude', '2000000.0')} AS spatial_group FROM located)"""


# ---- multi-label relevance --------------------------------------------------

def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sets per item; query rows alternate development and final, some unlabeled."""
    items = store(spark, sf_dir).select("item_id", "position", "split").join(
        read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), F.col("label").alias("n")),
        "position",
    )
    p = F.col("position")
    second = ((F.col("n") + p % 3) % 10).cast("string")
    labels = F.array_sort(F.array_distinct(F.array(F.col("n").cast("string"), second)))
    partition = F.when(F.col("split") == "index", "index").otherwise(
        F.when(p % 2 == 0, "development").otherwise("final")
    )
    none = (F.col("split") == "query") & (p % 31 == 4)
    return items.select(
        "item_id",
        F.when(none, F.array().cast("array<string>")).otherwise(labels).alias("labels"),
        partition.alias("partition"),
    )


SQL_RELEVANCE = """
relevance AS (
  SELECT s.item_id, s.position, s.e,
    CASE WHEN s.split = 'query' AND s.position % 31 = 4 THEN [] ELSE list_sort(list_distinct(
      [CAST(m.label AS VARCHAR), CAST((m.label + m.vec_id % 3) % 10 AS VARCHAR)])) END AS labels,
    CASE WHEN s.split = 'index' THEN 'index' WHEN s.position % 2 = 0 THEN 'development' ELSE 'final' END AS "partition"
  FROM store s JOIN embeddings m ON m.vec_id = s.position)"""


# ---- benchmark candidates ---------------------------------------------------

def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Georeferenced candidates from orders: priority is the class."""
    key = F.col("o_orderkey")
    lon = F.lit(5.0) + F.pmod(key * 7919, F.lit(9973)) / 1000.0
    lat = F.lit(45.0) + F.pmod(key * 4729, F.lit(9967)) / 1000.0
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("m"), key.cast("string")).alias("member"),
        F.col("o_orderpriority").alias("label"),
        lon.alias("longitude"),
        lat.alias("latitude"),
        geo.lonlat_cell(lon, lat).alias("spatial_group"),
        key.alias("key"),
    )


def used_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).filter(F.col("key") % 97 == 5).select(
        "member", "longitude", "latitude"
    )


SQL_CANDIDATES = f"""
located_orders AS (
  SELECT 'm' || CAST(o_orderkey AS VARCHAR) AS member, o_orderpriority AS label, o_orderkey AS key,
    CAST(5.0 + ((o_orderkey * 7919) % 9973) / 1000.0 AS DOUBLE) AS longitude,
    CAST(45.0 + ((o_orderkey * 4729) % 9967) / 1000.0 AS DOUBLE) AS latitude FROM orders),
candidates AS (SELECT *, {sql_cell('longitude', 'latitude')} AS spatial_group FROM located_orders),
used AS (SELECT * FROM candidates WHERE key % 97 = 5)"""


# ---- patch metadata and footprints -----------------------------------------

def raw_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch metadata rows from orders, repeats included."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    letter = F.when(cust % 2 == 0, "U").otherwise("T")
    tile = F.concat(F.lpad((29 + cust % 8).cast("string"), 2, "0"), letter, F.lit("UP"))
    patch = F.concat(
        F.lit("S2A_MSIL2A_"), F.date_format("o_orderdate", "yyyyMMdd"),
        F.lit("T101031_N9999_R022_T"), tile, F.lit("_"),
        F.lpad((cust % 100).cast("string"), 2, "0"), F.lit("_"),
        F.lpad((key % 100).cast("string"), 2, "0"),
    )
    split = F.element_at(
        F.create_map(F.lit("F"), F.lit("train"), F.lit("O"), F.lit("test"), F.lit("P"), F.lit("validation")),
        F.col("o_orderstatus"),
    )
    return read(spark, sf_dir, "orders").select(
        patch.alias("patch_id"),
        F.array(F.col("o_orderpriority"), F.concat(F.lit("class-"), (cust % 6).cast("string"))).alias("labels"),
        split.alias("split"),
        F.concat(F.lit("NATION_"), (cust % 25).cast("string")).alias("country"),
        F.concat(F.lit("S1_"), key.cast("string")).alias("s1_name"),
        F.concat(F.lit("S2_"), key.cast("string")).alias("s2v1_name"),
        (key % 53 == 0).alias("contains_seasonal_snow"),
        (key % 47 == 0).alias("contains_cloud_or_shadow"),
        key.alias("key"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata row per patch id: the earliest order wins."""
    rows = raw_patches(spark, sf_dir)
    first = rows.groupBy("patch_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "patch_id"]), "key").alias("r"))
    return first.select("patch_id", "r.*")


def patch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch ids with the key of the row that ``patches`` takes, without its other columns."""
    return raw_patches(spark, sf_dir).groupBy("patch_id").agg(F.min("key").alias("key"))


def footprints(rows: DataFrame, *carried: str) -> DataFrame:
    """Native UTM square of every patch id, from its tile, row and column."""
    parts = F.split("patch_id", "_")
    tile = F.substring(parts[5], 2, 5)
    left = 300_000.0 + parts[6].cast("int") * 4_000.0
    base = F.when(F.substring(tile, 3, 1) == "U", 5_400_000.0).otherwise(4_500_000.0)
    bottom = base + parts[7].cast("int") * 4_000.0
    return rows.select(
        "patch_id", *carried, geo.mgrs_epsg(tile).alias("epsg"),
        left.alias("left"), bottom.alias("bottom"),
        (left + 1_200.0).alias("right"), (bottom + 1_200.0).alias("top"),
    )


def sql_utm(epsg: str, x: str, y: str) -> tuple[str, str]:
    """The transverse Mercator inverse as SQL text (northern zones)."""
    radius, beta, delta = geo.utm_inverse_coefficients()
    xi, eta = f"(({y}) / {geo.UTM_SCALE * radius!r})", f"((({x}) - 500000.0) / {geo.UTM_SCALE * radius!r})"
    xip, etap = xi, eta
    for j, b in enumerate(beta, start=1):
        xip += f" - {b!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
        etap += f" - {b!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
    chi = f"asin(sin({xip}) / cosh({etap}))"
    lat = chi + "".join(f" + {d!r} * sin({2 * j} * {chi})" for j, d in enumerate(delta, start=1))
    lon = f"(({epsg}) % 100) * 6 - 183 + degrees(atan2(sinh({etap}), cos({xip})))"
    return lon, f"degrees({lat})"


_UTM_LON, _UTM_LAT = sql_utm("epsg", "(\"left\" + \"right\") / 2", "(bottom + top) / 2")
SQL_RAW_PATCHES = """
raw_patches AS (
  SELECT 'S2A_MSIL2A_' || strftime(o_orderdate, '%Y%m%d') || 'T101031_N9999_R022_T' ||
      lpad(CAST(29 + o_custkey % 8 AS VARCHAR), 2, '0') || CASE WHEN o_custkey % 2 = 0 THEN 'U' ELSE 'T' END || 'UP_' ||
      lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || '_' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS patch_id,
    [o_orderpriority, 'class-' || CAST(o_custkey % 6 AS VARCHAR)] AS labels,
    CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test' WHEN 'P' THEN 'validation' END AS split,
    'NATION_' || CAST(o_custkey % 25 AS VARCHAR) AS country, 'S1_' || CAST(o_orderkey AS VARCHAR) AS s1_name,
    'S2_' || CAST(o_orderkey AS VARCHAR) AS s2v1_name, o_orderkey % 53 = 0 AS contains_seasonal_snow,
    o_orderkey % 47 = 0 AS contains_cloud_or_shadow, o_orderkey AS key,
    CAST(o_orderdate AS DATE) AS day FROM orders)"""
SQL_PATCHES = SQL_RAW_PATCHES + """,
patches AS (SELECT * FROM raw_patches QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY key) = 1)"""
SQL_FOOTPRINTS = SQL_PATCHES + f""",
fp0 AS (SELECT patch_id, split_part(patch_id, '_', 6)[2:6] AS tile, CAST(split_part(patch_id, '_', 7) AS INTEGER) AS rr,
  CAST(split_part(patch_id, '_', 8) AS INTEGER) AS cc FROM patches),
fp AS (SELECT patch_id, CAST(CASE WHEN tile[3] >= 'N' THEN 32600 ELSE 32700 END + CAST(tile[1:2] AS INTEGER) AS INTEGER) AS epsg,
  CAST(300000.0 + rr * 4000.0 AS DOUBLE) AS "left",
  CAST(CASE WHEN tile[3] = 'U' THEN 5400000.0 ELSE 4500000.0 END + cc * 4000.0 AS DOUBLE) AS bottom FROM fp0),
fp2 AS (SELECT *, "left" + 1200.0 AS "right", bottom + 1200.0 AS top FROM fp),
fp3 AS (SELECT *, {_UTM_LON} AS longitude, {_UTM_LAT} AS latitude FROM fp2),
footprints AS (SELECT *, {sql_cell('longitude', 'latitude')} AS spatial_group FROM fp3)"""


# ---- places and acquisitions ------------------------------------------------

def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("bigint") * 1000
    lon, lat = lonlat(key)
    return read(spark, sf_dir, "nation").select(
        F.lower("n_name").alias("place_id"), lon.alias("longitude"), lat.alias("latitude"),
        F.col("n_nationkey").cast("bigint").alias("key"),
    )


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items of a place: one per order, with a cloud share that may be missing."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("nation_"), (cust % 25).cast("string")).alias("place_id"),
        F.lpad(key.cast("string"), 10, "0").alias("item_id"),
        F.when(key % 613 != 0, F.col("o_orderdate")).alias("datetime"),
        F.when(key % 41 != 0, F.floor(F.col("o_totalprice") % 100).cast("double")).alias("cloud"),
        key.alias("key"),
    )


SQL_PLACES = """
places AS (SELECT lower(n_name) AS place_id, n_nationkey AS key,
  CAST(((CAST(n_nationkey AS BIGINT) * 1000 * 7919) % 36000) / 100.0 - 180.0 AS DOUBLE) AS longitude,
  CAST(((CAST(n_nationkey AS BIGINT) * 1000 * 4729) % 14000) / 100.0 - 70.0 AS DOUBLE) AS latitude FROM nation)"""
SQL_ACQUISITIONS = """
acq AS (SELECT 'nation_' || CAST(o_custkey % 25 AS VARCHAR) AS place_id, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS item_id,
  CASE WHEN o_orderkey % 613 <> 0 THEN o_orderdate END AS datetime, o_orderkey AS key,
  CASE WHEN o_orderkey % 41 <> 0 THEN CAST(floor(o_totalprice % 100) AS DOUBLE) END AS cloud FROM orders),
dayed AS (SELECT *, coalesce(strftime(datetime, '%Y-%m-%d'), 'unknown') AS acquisition_day FROM acq),
obs AS (SELECT *, count(*) OVER (PARTITION BY place_id, acquisition_day) AS items_that_day FROM dayed
  QUALIFY row_number() OVER (PARTITION BY place_id, acquisition_day ORDER BY coalesce(cloud, 1e300), datetime NULLS FIRST, item_id) = 1)"""
