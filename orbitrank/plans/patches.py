"""Registered queries over patch metadata, footprints and frozen partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitrank.functions import geo
from orbitrank.operators import checks, claims, metadata, selection
from orbitrank.operators.frames import stack
from orbitrank.plans.bindings import (
    SQL_FOOTPRINTS, SQL_PATCHES, SQL_RAW_PATCHES, footprints, patch_keys, patches, raw_patches, written,
    sql_haversine, sql_utm, with_sql,
)
from orbitrank.plans.registry import Registry, rounded
from orbitrank.sources import patches as source
from orbitrank.session import scratch_path

REGISTRY = Registry()
QUERIES, ORACLES, register = REGISTRY.queries, REGISTRY.oracles, REGISTRY.add

POLICY = selection.Policy(
    partitions={
        "index": selection.DrawWindow("train", "1995-01-01", "1997-03-31", 600),
        "development": selection.DrawWindow("validation", "1997-06-01", "1997-12-31", 60),
        "final": selection.DrawWindow("test", "1998-06-01", "1998-12-31", 60),
    },
    exclude_from_final=("S2A_MSIL2A_19980615T101031_N9999_R022_T33UUP_04_11",),
)


def inventory(spark, sf_dir):
    return written(
        spark, "inventory",
        lambda: source.add_centers(footprints(patches(spark, sf_dir).select("patch_id"))),
    )


def recommended(spark, sf_dir):
    return patches(spark, sf_dir).filter(~(F.col("contains_seasonal_snow") | F.col("contains_cloud_or_shadow")))


def excluded(spark, sf_dir):
    return patches(spark, sf_dir).filter(F.col("contains_seasonal_snow") | F.col("contains_cloud_or_shadow"))


def placed(spark, sf_dir):
    """Recommended metadata joined one-to-one with its geometry."""
    return written(
        spark, "placed_patches",
        lambda: source.join_candidates(recommended(spark, sf_dir).drop("key"), inventory(spark, sf_dir)),
    )


SQL_PLACED = SQL_FOOTPRINTS + """,
placed AS (SELECT p.*, f.* EXCLUDE (patch_id) FROM patches p JOIN footprints f USING (patch_id)
  WHERE NOT (contains_seasonal_snow OR contains_cloud_or_shadow))"""

_TILE = "split_part(patch_id, '_', 6)[2:6]"
_GRID = "split_part(patch_id, '_', 6)[2:] || '_' || split_part(patch_id, '_', 7) || '_' || split_part(patch_id, '_', 8)"


@register("meta_scan", with_sql(SQL_PATCHES) + "SELECT patch_id, array_to_string(labels, ',') AS labels, split, country FROM patches")
def q_meta_scan(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    patches(spark, sf_dir).write.parquet(path)
    return source.read_metadata(spark, path).select(
        "patch_id", F.array_join("labels", ",").alias("labels"), "split", "country"
    )


@register(
    "meta_identities",
    with_sql(SQL_RAW_PATCHES) + """SELECT patch_id, count(*) FILTER (NOT (contains_seasonal_snow OR contains_cloud_or_shadow)) AS recommended,
  count(*) FILTER (contains_seasonal_snow OR contains_cloud_or_shadow) AS excluded FROM raw_patches GROUP BY patch_id""",
)
def q_identities(spark, sf_dir):
    rows = raw_patches(spark, sf_dir)
    flagged = F.col("contains_seasonal_snow") | F.col("contains_cloud_or_shadow")
    return source.identities(rows.filter(~flagged), rows.filter(flagged))


@register(
    "identity_violations",
    with_sql(SQL_RAW_PATCHES) + """, b AS (SELECT key % 7000 AS patch_id, key % 5 = 0 AS ex FROM raw_patches),
c AS (SELECT patch_id, count(*) FILTER (NOT ex) AS r, count(*) FILTER (ex) AS e FROM b GROUP BY patch_id)
SELECT CASE WHEN r > 0 AND e > 0 THEN 'in_both_files' ELSE 'duplicate_patch_id' END AS rule, CAST(patch_id AS VARCHAR) AS key
FROM c WHERE (r > 0 AND e > 0) OR r > 1 OR e > 1""",
)
def q_identity_violations(spark, sf_dir):
    rows = raw_patches(spark, sf_dir).select((F.col("key") % 7000).cast("string").alias("patch_id"), "key")
    ex = F.col("key") % 5 == 0
    return source.identity_violations(source.identities(rows.filter(~ex), rows.filter(ex)))


@register(
    "footprint_inventory",
    with_sql(SQL_FOOTPRINTS) + "SELECT patch_id, epsg, round(longitude, 7) AS longitude, round(latitude, 7) AS latitude, spatial_group FROM footprints",
)
def q_inventory(spark, sf_dir):
    path = scratch_path(spark, "footprints")
    source.write_inventory(footprints(patches(spark, sf_dir).select("patch_id")), path)
    written = spark.read.parquet(path)
    return written.select(
        "patch_id", "epsg", F.round("longitude", 7).alias("longitude"), F.round("latitude", 7).alias("latitude"), "spatial_group"
    )


@register("footprint_crs_counts", with_sql(SQL_FOOTPRINTS) + "SELECT epsg, count(*) AS patches FROM footprints GROUP BY epsg")
def q_crs(spark, sf_dir):
    return source.crs_counts(footprints(patches(spark, sf_dir)))


@register(
    "candidates_join",
    with_sql(SQL_PLACED) + "SELECT patch_id, split, country, epsg, spatial_group FROM placed",
)
def q_candidates(spark, sf_dir):
    joined = source.join_candidates(recommended(spark, sf_dir), inventory(spark, sf_dir))
    return joined.select("patch_id", "split", "country", "epsg", "spatial_group")


@register(
    "coverage_violations",
    with_sql(SQL_PATCHES) + """SELECT 'missing_footprint' AS rule, patch_id AS key FROM patches WHERE key % 37 = 2 AND key % 41 <> 3
UNION ALL SELECT 'foreign_footprint', patch_id FROM patches WHERE key % 41 = 3 AND key % 37 <> 2""",
)
def q_coverage(spark, sf_dir):
    rows = patches(spark, sf_dir)
    return source.coverage_violations(rows.filter("key % 41 <> 3"), rows.filter("key % 37 <> 2"))


@register(
    "frozen_semi_join",
    with_sql(SQL_PATCHES) + "SELECT patch_id, array_to_string(labels, ',') AS labels, split FROM patches WHERE key % 9 = 1",
)
def q_frozen(spark, sf_dir):
    rows = patches(spark, sf_dir)
    found = source.frozen_inputs(rows, rows.filter("key % 9 = 1"))
    return found.withColumn("labels", F.array_join("labels", ","))


@register(
    "patch_parse",
    with_sql(SQL_PATCHES) + f"""SELECT patch_id, day AS acquisition_day, {_TILE} AS tile,
  CAST(split_part(patch_id, '_', 7) AS INTEGER) AS "row", CAST(split_part(patch_id, '_', 8) AS INTEGER) AS "column", {_GRID} AS grid FROM patches""",
)
def q_parse(spark, sf_dir):
    found = patches(spark, sf_dir).select("patch_id")
    return found.withColumns(source.parse_patch_id(F.col("patch_id")))


@register(
    "mgrs_epsg",
    with_sql(SQL_PATCHES) + f"""SELECT patch_id, CAST(CASE WHEN {_TILE}[3] >= 'N' THEN 32600 ELSE 32700 END + CAST({_TILE}[1:2] AS INTEGER) AS INTEGER) AS epsg FROM patches""",
)
def q_mgrs(spark, sf_dir):
    tile = F.substring(F.split("patch_id", "_")[5], 2, 5)
    return patches(spark, sf_dir).select("patch_id", geo.mgrs_epsg(tile).alias("epsg"))


@register("utm_center", with_sql(SQL_FOOTPRINTS) + "SELECT patch_id, round(longitude, 7) AS longitude, round(latitude, 7) AS latitude FROM footprints")
def q_utm(spark, sf_dir):
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("bottom") + F.col("top")) / 2
    return geo.add_lonlat(footprints(patches(spark, sf_dir)), F.col("epsg"), x, y).select(
        "patch_id", F.round("longitude", 7).alias("longitude"), F.round("latitude", 7).alias("latitude")
    )


# ---- metadata audit ---------------------------------------------------------

_STATS = """count(*) AS rows, min(day) AS date_min, max(day) AS date_max, count(DISTINCT day) AS unique_acquisition_dates,
  count(DISTINCT {tile}) AS mgrs_tiles, count(*) FILTER (contains_seasonal_snow) AS seasonal_snow,
  count(*) FILTER (contains_cloud_or_shadow) AS cloud_or_shadow,
  count(*) FILTER (contains_seasonal_snow AND contains_cloud_or_shadow) AS both""".format(tile=_TILE)


@register("meta_summary", with_sql(SQL_PATCHES) + f"SELECT split, {_STATS} FROM patches GROUP BY GROUPING SETS ((), (split))")
def q_summary(spark, sf_dir):
    return metadata.summary(patches(spark, sf_dir))


@register("meta_months", with_sql(SQL_PATCHES) + "SELECT split, strftime(day, '%Y-%m') AS month, count(*) AS rows FROM patches GROUP BY ALL")
def q_months(spark, sf_dir):
    return metadata.months(patches(spark, sf_dir))


@register("meta_countries", with_sql(SQL_PATCHES) + "SELECT split, country, count(*) AS rows FROM patches GROUP BY ALL")
def q_countries(spark, sf_dir):
    return metadata.countries(patches(spark, sf_dir))


@register(
    "meta_labels",
    with_sql(SQL_PATCHES) + """, e AS (SELECT split, unnest(labels) AS label FROM patches WHERE key % 600 <> 0 OR split <> 'test')
SELECT label, s.split, count(e.label) AS rows FROM (SELECT DISTINCT label FROM e) d
CROSS JOIN (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN e USING (label, split) GROUP BY label, s.split""",
)
def q_labels(spark, sf_dir):
    return metadata.label_counts(patches(spark, sf_dir).filter("key % 600 <> 0 OR split <> 'test'"))


@register(
    "shared_dates",
    with_sql(SQL_PATCHES) + """, d AS (SELECT DISTINCT split, day FROM patches)
SELECT a || '/' || b AS pair, (SELECT count(*) FROM d x JOIN d y USING (day) WHERE x.split = a AND y.split = b) AS dates
FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) p(a, b)""",
)
def q_shared_dates(spark, sf_dir):
    return metadata.shared_dates(patches(spark, sf_dir))


@register(
    "grid_identity",
    with_sql(SQL_PATCHES) + f""", g AS (SELECT {_GRID} AS grid, count(DISTINCT split) AS s, count(DISTINCT day) AS d FROM patches GROUP BY 1)
SELECT count(*) AS unique_keys, count(*) FILTER (s > 1) AS keys_in_multiple_splits, count(*) FILTER (d > 1) AS keys_on_multiple_dates FROM g""",
)
def q_grid_identity(spark, sf_dir):
    return metadata.grid_identity(patches(spark, sf_dir))


@register(
    "meta_violations",
    with_sql(SQL_RAW_PATCHES) + """, b AS (SELECT CASE WHEN key % 101 = 0 THEN replace(patch_id, 'MSIL2A', 'MSIL1C') ELSE patch_id END AS patch_id,
  CASE WHEN key % 103 = 0 THEN 'holdout' ELSE split END AS split, CASE WHEN key % 107 = 0 THEN [] WHEN key % 109 = 0 THEN ['a', 'a'] ELSE labels END AS labels,
  CASE WHEN key % 113 = 0 THEN '  ' ELSE country END AS country, contains_seasonal_snow OR contains_cloud_or_shadow AS flagged FROM raw_patches)
SELECT 'invalid_patch_id' AS rule, patch_id AS key FROM b WHERE patch_id LIKE '%MSIL1C%'
UNION ALL SELECT 'unknown_split', patch_id FROM b WHERE split = 'holdout'
UNION ALL SELECT 'bad_labels', patch_id FROM b WHERE len(labels) = 0
UNION ALL SELECT 'duplicate_label', patch_id FROM b WHERE labels = ['a', 'a']
UNION ALL SELECT 'blank_country', patch_id FROM b WHERE trim(country) = ''
UNION ALL SELECT 'flags_disagree_with_file', patch_id FROM b WHERE flagged
UNION ALL SELECT 'duplicate_patch_id', patch_id FROM b GROUP BY patch_id HAVING count(*) > 1""",
)
def q_meta_violations(spark, sf_dir):
    key = F.col("key")
    damaged = raw_patches(spark, sf_dir).withColumns({
        "patch_id": F.when(key % 101 == 0, F.replace("patch_id", F.lit("MSIL2A"), F.lit("MSIL1C"))).otherwise(F.col("patch_id")),
        "split": F.when(key % 103 == 0, "holdout").otherwise(F.col("split")),
        "labels": F.when(key % 107 == 0, F.array().cast("array<string>")).when(
            key % 109 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.col("labels")),
        "country": F.when(key % 113 == 0, "  ").otherwise(F.col("country")),
    })
    return metadata.metadata_violations(damaged, excluded=False)


# ---- frozen partitions ------------------------------------------------------

_WINDOW = """split = 'test' AND day BETWEEN DATE '1998-06-01' AND DATE '1998-12-31' AND patch_id <> '""" + POLICY.exclude_from_final[0] + "'"


@register("window_filter", with_sql(SQL_PLACED) + f"SELECT patch_id, spatial_group FROM placed WHERE {_WINDOW}")
def q_window(spark, sf_dir):
    return selection.window_filter(placed(spark, sf_dir), "final", POLICY).select("patch_id", "spatial_group")


@register(
    "cell_anti",
    with_sql(SQL_PLACED) + f"""SELECT patch_id FROM placed WHERE split = 'train' AND spatial_group NOT IN (SELECT spatial_group FROM placed WHERE {_WINDOW})""",
)
def q_cell_anti(spark, sf_dir):
    rows = placed(spark, sf_dir)
    used = selection.window_filter(rows, "final", POLICY)
    return selection.cell_disjoint(rows.filter("split = 'train'"), used).select("patch_id")


@register(
    "grid_dedupe",
    with_sql(SQL_PLACED) + f"""SELECT patch_id, spatial_group FROM placed
QUALIFY row_number() OVER (PARTITION BY {_GRID} ORDER BY sha256('42:' || patch_id)) = 1""",
)
def q_grid_dedupe(spark, sf_dir):
    return selection.grid_dedupe(placed(spark, sf_dir), 42).select("patch_id", "spatial_group")


def _selected(spark, sf_dir):
    return written(
        spark, "selected",
        lambda: selection.select_partitions(placed(spark, sf_dir), POLICY).rows,
    )


def _sql_eligible(name: str, used: tuple[str, ...]) -> str:
    """A partition's candidates: in its split and window, clear of earlier ones' cells and distance."""
    spec = POLICY.partitions[name]
    rows = f"""SELECT * FROM placed WHERE split = '{spec.official_split}' AND day BETWEEN DATE '{spec.start}' AND DATE '{spec.end}'"""
    if name == "final":
        rows += f" AND patch_id NOT IN ('{POLICY.exclude_from_final[0]}')"
    clear = "".join(
        f""" AND spatial_group NOT IN (SELECT spatial_group FROM chosen_{x})
  AND patch_id NOT IN (SELECT t.patch_id FROM timely_{name} t, chosen_{x} c WHERE
    {sql_haversine("t.longitude", "t.latitude", "c.longitude", "c.latitude")} < {POLICY.minimum_center_distance_m})"""
        for x in used
    )
    return f"timely_{name} AS ({rows}),\neligible_{name} AS (SELECT * FROM timely_{name} WHERE true{clear})"


def _sql_cells(name: str) -> str:
    """The cells that a partition owns, one claim of the rarest unserved label a step."""
    size, least, minimum = POLICY.partitions[name].size, POLICY.minimum_query_cells, POLICY.minimum_label_count
    served = f"coalesce(list_position([x < {minimum} for x in have], true), 0)"
    first = "count(*) OVER ahead >= 0" if name == "index" else f"""mine
  OR (SELECT count(*) FROM marked_{name} WHERE mine) + count(*) FILTER (NOT mine) OVER ahead < {least}
  OR (SELECT coalesce(sum(n), 0) FROM marked_{name} WHERE mine) + coalesce(sum(n) FILTER (NOT mine) OVER ahead, 0) < {size}"""
    return f"""unique_{name} AS (SELECT *, sha256('42:' || patch_id) AS h FROM eligible_{name}
  QUALIFY row_number() OVER (PARTITION BY {_GRID} ORDER BY h) = 1),
rare_{name} AS (SELECT list(label ORDER BY total, label) AS names FROM (
  SELECT label, count(l) AS total FROM (SELECT DISTINCT unnest(labels) AS label FROM placed) d
  LEFT JOIN (SELECT unnest(labels) AS l FROM unique_{name}) u ON l = label GROUP BY label)),
cells_{name} AS (SELECT spatial_group, sha256('42:' || spatial_group) AS o, n,
  [len([y for y in held if y = x]) for x in names] AS gains
  FROM (SELECT spatial_group, count(*) AS n, flatten(list(labels)) AS held FROM unique_{name} GROUP BY 1), rare_{name}),
claims_{name} AS (
  SELECT 0 AS step, CAST([] AS VARCHAR[]) AS claimed, [CAST(0 AS BIGINT) for x in names] AS have FROM rare_{name}
  UNION ALL
  SELECT step + 1, list_append(claimed, won), [have[k] + more[k] for k in range(1, len(have) + 1)]
  FROM (SELECT step, claimed, have, arg_min(spatial_group, place) AS won, arg_min(gains, place) AS more
    FROM (SELECT *, printf('%09d', 999999999 - least({minimum} - have[i], gains[i])) || o AS place
    FROM (SELECT s.*, c.spatial_group, c.o, c.gains, {served} AS i FROM claims_{name} s, cells_{name} c
      WHERE NOT list_contains(s.claimed, c.spatial_group)) WHERE i > 0 AND gains[i] > 0)
    GROUP BY step, claimed, have)),
marked_{name} AS (SELECT c.*, list_contains(claimed, spatial_group) AS mine
  FROM cells_{name} c, (SELECT arg_max(claimed, step) AS claimed FROM claims_{name})),
owned_{name} AS (SELECT spatial_group, o, n FROM marked_{name}
  WINDOW ahead AS (ORDER BY mine, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY {first})"""


def _sql_chosen(name: str) -> str:
    """First row of each owned cell, rows added for labels one a step, the rest in turns."""
    size, minimum = POLICY.partitions[name].size, POLICY.minimum_label_count
    served = f"coalesce(list_position([x < {minimum} for x in have], true), 0)"
    return f"""pool_{name} AS (SELECT u.*, o, row_number() OVER (PARTITION BY spatial_group ORDER BY h) AS turn
  FROM unique_{name} u JOIN owned_{name} USING (spatial_group)),
added_{name} AS (
  SELECT 0 AS step, CAST([] AS VARCHAR[]) AS added,
    [len([y for y in held if y = x]) for x in names] AS have, names
  FROM rare_{name}, (SELECT flatten(list(labels)) AS held FROM pool_{name} WHERE turn = 1)
  UNION ALL
  SELECT step + 1, list_append(added, won), [have[k] + CAST(list_contains(more, names[k]) AS BIGINT) for k in range(1, len(have) + 1)], names
  FROM (SELECT step, added, have, names, arg_min(patch_id, h) AS won, arg_min(labels, h) AS more
    FROM (SELECT s.*, p.patch_id, p.labels, p.h, {served} AS i FROM added_{name} s, pool_{name} p
      WHERE p.turn > 1 AND NOT list_contains(s.added, p.patch_id)) WHERE i > 0 AND list_contains(labels, names[i])
    GROUP BY step, added, have, names)),
filled_{name} AS (SELECT p.*, turn = 1 OR list_contains(a.added, patch_id) AS taken
  FROM pool_{name} p, (SELECT arg_max(added, step) AS added FROM added_{name}) a),
chosen_{name} AS (SELECT patch_id, spatial_group, longitude, latitude FROM filled_{name} QUALIFY taken
  OR row_number() OVER (PARTITION BY taken ORDER BY turn, o) <= {size} - (SELECT count(*) FROM filled_{name} WHERE taken))"""


def _sql_partitions() -> str:
    ctes = [SQL_PLACED]
    for at, name in enumerate(POLICY.order):
        ctes += [_sql_eligible(name, tuple(POLICY.order[:at])), _sql_cells(name), _sql_chosen(name)]
    return with_sql(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


_ALLOCATION_SQL = with_sql(SQL_PLACED, _sql_eligible("final", ()), _sql_cells("final")).replace("WITH ", "WITH RECURSIVE ", 1)


@register("cell_allocation", _ALLOCATION_SQL + "SELECT spatial_group, o AS cell_order, n FROM owned_final")
def q_allocation(spark, sf_dir):
    """Cells the final partition owns."""
    unique = selection.grid_dedupe(selection.window_filter(placed(spark, sf_dir), "final", POLICY), 42)
    labels = claims.label_domain(placed(spark, sf_dir))
    return selection.allocate_cells(unique, labels, POLICY.partitions["final"].size, POLICY, False)


@register(
    "select_partitions",
    _sql_partitions() + " UNION ALL ".join(
        f"SELECT '{name}' AS partition, patch_id, spatial_group FROM chosen_{name}" for name in POLICY.order
    ),
)
def q_select(spark, sf_dir):
    chosen = selection.select_partitions(placed(spark, sf_dir), POLICY)
    return chosen.rows.select("partition", "patch_id", "spatial_group")


@register(
    "feasibility",
    _sql_partitions() + " UNION ALL ".join(
        f"""SELECT '{name}' AS partition, (SELECT count(*) FROM timely_{name}) AS after_temporal_filter,
  count(*) AS after_spatial_filter, count(DISTINCT spatial_group) AS available_cells FROM eligible_{name}"""
        for name in POLICY.order
    ),
)
def q_feasibility(spark, sf_dir):
    return selection.select_partitions(placed(spark, sf_dir), POLICY).feasibility


def simple_selection(spark, sf_dir):
    """A plain date-window selection that ignores every guard, for the audit to judge."""
    rows = placed(spark, sf_dir)
    return stack(*[
        selection.window_filter(rows, name, POLICY).withColumn("partition", F.lit(name))
        for name in POLICY.partitions
    ])


SQL_SIMPLE = SQL_PLACED + f""",
simple AS (SELECT *, 'final' AS part FROM placed WHERE {_WINDOW}
  UNION ALL SELECT *, 'development' FROM placed WHERE split = 'validation' AND day BETWEEN DATE '1997-06-01' AND DATE '1997-12-31'
  UNION ALL SELECT *, 'index' FROM placed WHERE split = 'train' AND day BETWEEN DATE '1995-01-01' AND DATE '1997-03-31')"""


def _sql_radius() -> str:
    parts = []
    for x in ('"left"', '"right"'):
        for y in ("bottom", "top"):
            lon, lat = sql_utm("epsg", x, y)
            parts.append(sql_haversine(lon, lat, "longitude", "latitude"))
    return f"greatest({', '.join(parts)})"


SQL_PAIRS = SQL_SIMPLE + f""",
stats AS (SELECT part, count(*) AS patches, count(DISTINCT spatial_group) AS cells, min(day) AS date_min, max(day) AS date_max,
  max({_sql_radius()}) AS radius FROM simple GROUP BY part),
pairs AS (SELECT l, r, (SELECT count(*) FROM (SELECT spatial_group FROM simple WHERE part = l INTERSECT SELECT spatial_group FROM simple WHERE part = r)) AS shared,
  (SELECT min({sql_haversine('a.longitude', 'a.latitude', 'b.longitude', 'b.latitude')}) FROM simple a, simple b WHERE a.part = l AND b.part = r) AS d
  FROM (VALUES ('index', 'development'), ('index', 'final'), ('development', 'final')) v(l, r)),
separation AS (SELECT l AS left_partition, r AS right_partition, shared AS shared_cells, d AS minimum_center_distance_m,
  d - 1.01 * (x.radius + y.radius) AS bound, CAST(y.date_min - x.date_max AS INTEGER) AS gap
  FROM pairs JOIN stats x ON x.part = l JOIN stats y ON y.part = r)"""


@register(
    "pairwise_separation",
    with_sql(SQL_PAIRS) + """SELECT left_partition, right_partition, shared_cells, round(minimum_center_distance_m, 3) AS minimum_center_distance_m,
  round(bound, 3) AS footprint_separation_lower_bound_m, gap AS temporal_gap_days FROM separation""",
)
def q_separation(spark, sf_dir):
    found = selection.pairwise_separation(simple_selection(spark, sf_dir), list(POLICY.partitions))
    return rounded(found, 3)


@register(
    "partition_stats",
    with_sql(SQL_PAIRS) + """SELECT part AS "partition", patches, cells, date_min, date_max, round(radius, 3) AS maximum_corner_radius_m FROM stats""",
)
def q_stats(spark, sf_dir):
    return rounded(selection.partition_stats(simple_selection(spark, sf_dir)), 3)


@register(
    "audit_selection",
    with_sql(SQL_PAIRS) + f""", c AS (SELECT part, unnest(labels) AS label FROM simple),
want AS (SELECT * FROM (VALUES ('index', 600, 0), ('development', 60, 20), ('final', 60, 20)) v(part, size, least))
SELECT 'repeated_grid' AS rule, {_GRID.replace("split_part(patch_id, '_', 6)[2:]", "split_part(patch_id, '_', 6)")} AS key FROM simple GROUP BY part, 2 HAVING count(*) > 1
UNION ALL SELECT 'partition_size', part FROM want LEFT JOIN stats USING (part) WHERE coalesce(patches, 0) <> size
UNION ALL SELECT 'too_few_cells', part FROM want LEFT JOIN stats USING (part) WHERE coalesce(cells, 0) < least
UNION ALL SELECT 'label_minimum', part || '/' || label FROM (SELECT w.part, d.label, (SELECT count(*) FROM c WHERE c.part = w.part AND c.label = d.label) AS n
  FROM want w, (SELECT DISTINCT unnest(labels) AS label FROM placed) d) WHERE n < 5
UNION ALL SELECT 'cells_overlap', left_partition || '/' || right_partition FROM separation WHERE shared_cells > 0
UNION ALL SELECT 'center_distance', left_partition || '/' || right_partition FROM separation WHERE minimum_center_distance_m < 7000
UNION ALL SELECT 'footprint_bound', left_partition || '/' || right_partition FROM separation WHERE bound < 5000
UNION ALL SELECT 'temporal_gap', left_partition || '/' || right_partition FROM separation WHERE gap < 30""",
)
def q_audit(spark, sf_dir):
    return selection.audit_selection(simple_selection(spark, sf_dir), placed(spark, sf_dir), POLICY)


@register("audit_selected")
def q_audit_selected(spark, sf_dir):
    """The real selection under the same audit: label counts, and no violation row."""
    rows = _selected(spark, sf_dir)
    broken = selection.audit_selection(rows, placed(spark, sf_dir), POLICY)
    counted = selection.label_counts(rows).select("partition", "label", "patches")
    return stack(
        counted,
        broken.select(F.lit("violation").alias("partition"), F.col("rule").alias("label"), F.lit(1).cast("bigint").alias("patches")),
    )


@register(
    "geometry_agreement",
    with_sql(SQL_FOOTPRINTS) + """, k AS (SELECT f.*, p.key FROM footprints f JOIN patches p USING (patch_id))
SELECT patch_id, CASE WHEN key % 59 = 0 AND key % 61 = 0 THEN 'epsg,left' WHEN key % 59 = 0 THEN 'left' ELSE 'epsg' END AS fields
FROM k WHERE key % 59 = 0 OR key % 61 = 0""",
)
def q_geometry(spark, sf_dir):
    keyed = footprints(patches(spark, sf_dir)).join(patches(spark, sf_dir).select("patch_id", "key"), "patch_id")
    reread = keyed.withColumns({
        "left": F.when(F.col("key") % 59 == 0, F.col("left") + 10).otherwise(F.col("left")),
        "epsg": F.when(F.col("key") % 61 == 0, F.col("epsg") + 1).otherwise(F.col("epsg")),
    })
    found = selection.geometry_disagreements(reread, inventory(spark, sf_dir))
    return found


# ---- raster conformance -----------------------------------------------------

# Metres to a pixel of each band.
BAND_GSD = {"B01": 60, "B02": 10, "B03": 10, "B04": 10, "B05": 20, "B06": 20, "B07": 20,
            "B08": 10, "B09": 60, "B11": 20, "B12": 20, "B8A": 20}
_BANDS = ", ".join(f"('{b}', {g})" for b, g in BAND_GSD.items())


def band_headers(spark, sf_dir):
    """Observed raster headers, a few of them off."""
    squares = footprints(patch_keys(spark, sf_dir), "key")
    bands = F.explode(F.create_map(*[x for b, g in BAND_GSD.items() for x in (F.lit(b), F.lit(g))])).alias("band", "gsd")
    rows = squares.select("*", bands)
    off = (F.col("key") % 67 == 0) & (F.col("band") == "B02")
    size = (F.lit(1200) / F.col("gsd")).cast("int")
    gsd = F.col("gsd").cast("double")
    return rows.select(
        "patch_id", "band", "gsd", "key",
        F.array("left", F.when(off, F.col("bottom") + 10).otherwise(F.col("bottom")), "right", "top").alias("bounds"),
        F.array(gsd, F.lit(0.0), F.col("left"), F.lit(0.0), -gsd, F.col("top")).alias("transform"),
        F.when(F.col("key") % 71 == 0, F.lit(None).cast("int")).otherwise(F.col("epsg")).alias("epsg"),
        F.when((F.col("key") % 73 == 0) & (F.col("band") == "B8A"), size + 1).otherwise(size).alias("height"),
        size.alias("width"),
        F.when((F.col("key") % 79 == 0) & (F.col("band") == "B12"), "int16").otherwise("uint16").alias("dtype"),
    )


@register(
    "band_geometry",
    with_sql(SQL_PATCHES) + f""", b AS (SELECT patch_id, key, band FROM patches, (VALUES {_BANDS}) v(band, gsd))
SELECT 'bounds_differ' AS rule, patch_id || '/' || band AS key FROM b WHERE key % 67 = 0 AND band = 'B02'
UNION ALL SELECT 'epsg_differs', patch_id || '/' || band FROM b WHERE key % 71 = 0
UNION ALL SELECT 'shape_differs', patch_id || '/' || band FROM b WHERE key % 73 = 0 AND band = 'B8A'
UNION ALL SELECT 'dtype_differs', patch_id || '/' || band FROM b WHERE key % 79 = 0 AND band = 'B12'""",
)
def q_band_geometry(spark, sf_dir):
    return checks.band_geometry_violations(band_headers(spark, sf_dir), footprints(patch_keys(spark, sf_dir)))


@register(
    "completeness",
    with_sql(SQL_PATCHES) + f""", b AS (SELECT patch_id, key, band FROM patches, (VALUES {_BANDS}) v(band, gsd)
  WHERE NOT (key % 83 = 0 AND band = 'B05') AND key % 89 <> 0)
SELECT 'not_received' AS rule, patch_id AS key FROM patches WHERE key % 89 = 0 AND key % 97 <> 0
UNION ALL SELECT 'foreign_patch', patch_id FROM patches WHERE key % 97 = 0 AND key % 89 <> 0
UNION ALL SELECT 'bands_incomplete', patch_id FROM patches WHERE key % 83 = 0 AND key % 89 <> 0
UNION ALL SELECT 'digest_mismatch', patch_id FROM patches WHERE key % 131 = 0 AND key % 89 <> 0""",
)
def q_completeness(spark, sf_dir):
    rows = patches(spark, sf_dir)
    digest = F.sha2(F.concat_ws("/", "patch_id", "band"), 256)
    received = rows.select("patch_id", "key", F.explode(F.array(*[F.lit(b) for b in BAND_GSD])).alias("band")).filter(
        "NOT (key % 83 = 0 AND band = 'B05') AND key % 89 <> 0"
    ).select(
        "patch_id", "band", digest.alias("file_sha256"),
        F.when((F.col("key") % 131 == 0) & (F.col("band") == "B03"), "").otherwise(digest).alias("observed_sha256"),
    )
    return checks.completeness_violations(rows.filter("key % 97 <> 0"), received, list(BAND_GSD))
