"""Spatially separated selections: class-balanced splits and frozen partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbitrank.functions.geo import add_lonlat, haversine_m
from orbitrank.functions.hashing import hashed_order
from orbitrank.operators import claims
from orbitrank.operators.checks import Rule, violations
from orbitrank.operators.frames import beside, stack
from orbitrank.operators.nearest import guard_band, nearest_distance
from orbitrank.operators.ranking import bucketed_rank, hashed_rank
from orbitrank.operators.splits import query_cells, spread_sample
from orbitrank.session import cut_lineage

# ---- class-balanced split with cells and a guard band -----------------------


@dataclass(frozen=True)
class SpatialSplit:
    """Queries and index rows, and the candidates dropped by the guard band."""

    query: DataFrame
    index: DataFrame
    excluded: DataFrame

    def manifest(self) -> DataFrame:
        return self.query.withColumn("split", F.lit("query")).unionByName(
            self.index.withColumn("split", F.lit("index"))
        )


def spatial_split(
    candidates: DataFrame, queries_per_class: int, index_per_class: int,
    minimum_separation_m: float = 5_000.0, seed: int = 42,
) -> SpatialSplit:
    """Query cells first, then queries, then index rows outside cells and guard band."""
    if queries_per_class < 1 or index_per_class < 1:
        raise ValueError("per-class counts must be positive")
    cells = query_cells(candidates, queries_per_class, seed).select("spatial_group")
    inside = candidates.join(cells, "spatial_group", "left_semi")
    queries = cut_lineage(
        spread_sample(inside, queries_per_class, seed, "query").drop("depth", "pick")
    )
    outside = candidates.join(cells, "spatial_group", "left_anti").withColumn(
        "left_id", F.col("member")
    )
    eligible = guard_band(outside, queries, minimum_separation_m)
    index = spread_sample(eligible.drop("left_id"), index_per_class, seed, "index")
    return SpatialSplit(
        query=queries,
        index=index.drop("depth", "pick"),
        excluded=outside.join(eligible.select("member"), "member", "left_anti").drop("left_id"),
    )


def class_shortfalls(manifest: DataFrame, labels: DataFrame, wanted: Mapping[str, int]) -> DataFrame:
    """Labels whose index or query count differs from what was asked for."""
    counts = manifest.groupBy("label").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in ("index", "query")]
    )
    full = labels.select("label").distinct().join(counts, "label", "full_outer")
    observed = full.select("label", *[F.coalesce(s, F.lit(0)).alias(s) for s in ("index", "query")])
    return observed.filter(
        (F.col("index") != wanted["index"]) | (F.col("query") != wanted["query"])
    )


def audit_spatial_split(
    manifest: DataFrame, labels: DataFrame, source: str, index_per_class: int, queries_per_class: int
) -> DataFrame:
    """Violations of a spatial-split manifest, geometry measured anew.

    ``manifest`` has (item_id, source, label, split, spatial_group, longitude,
    latitude, minimum_separation_m).
    """
    rows = violations(
        manifest, "item_id",
        [
            Rule("not_from_source", ~F.col("source").eqNullSafe(F.lit(source))),
            Rule("unlabeled", F.col("label").isNull()),
            Rule("no_spatial_metadata", F.col("spatial_group").isNull() | F.col("longitude").isNull()
                 | F.col("latitude").isNull() | F.col("minimum_separation_m").isNull()),
            Rule("negative_separation", F.col("minimum_separation_m") < 0),
        ],
    )
    crossing = (
        manifest.groupBy("spatial_group")
        .agg(F.min("split").alias("a"), F.max("split").alias("b"))
        .filter("a <> b")
        .select(F.lit("cell_crosses_splits").alias("rule"), F.col("spatial_group").alias("key"))
    )
    policies = (
        manifest.agg(
            F.min("minimum_separation_m").alias("a"), F.max("minimum_separation_m").alias("b")
        )
        .filter("a <> b")
        .select(F.lit("inconsistent_separation_policy").alias("rule"), F.lit("all").alias("key"))
    )
    classes = class_shortfalls(
        manifest, labels, {"index": index_per_class, "query": queries_per_class}
    ).select(F.lit("class_count_mismatch").alias("rule"), F.col("label").alias("key"))
    queries = manifest.filter("split = 'query'").withColumn("left_id", F.col("item_id"))
    near = nearest_distance(queries, manifest.filter("split = 'index'"))
    observed = beside(
        near.agg(F.min("nearest_m").alias("observed")),
        manifest.agg(F.max("minimum_separation_m").alias("declared")),
    )
    separation = observed.filter(F.col("observed") + 1e-6 < F.col("declared")).select(
        F.lit("separation_below_declared").alias("rule"), F.lit("all").alias("key")
    )
    return stack(rows, crossing, policies, classes, separation)


# ---- frozen partitions ------------------------------------------------------


@dataclass(frozen=True)
class DrawWindow:
    """Where one partition may be drawn from, and how many rows it takes."""

    official_split: str
    start: str
    end: str
    size: int


@dataclass(frozen=True)
class Policy:
    """Frozen selection protocol; partitions are drawn in ``order``."""

    partitions: Mapping[str, DrawWindow]
    order: Sequence[str] = ("final", "development", "index")
    seed: int = 42
    minimum_query_cells: int = 20
    minimum_label_count: int = 5
    minimum_center_distance_m: float = 7_000.0
    minimum_footprint_separation_m: float = 5_000.0
    minimum_temporal_gap_days: int = 30
    exclude_from_final: Sequence[str] = field(default_factory=tuple)


def patch_day(patch_id: Column) -> Column:
    return F.to_date(F.substring(F.split(patch_id, "_")[2], 1, 8), "yyyyMMdd")


def patch_grid(patch_id: Column) -> Column:
    return F.substring_index(patch_id, "_", -3)


def window_filter(candidates: DataFrame, name: str, policy: Policy) -> DataFrame:
    """Rows of the official split inside the closed date window, minus exclusions."""
    spec = policy.partitions[name]
    day = patch_day(F.col("patch_id"))
    kept = candidates.filter(
        (F.col("split") == spec.official_split)
        & day.between(F.lit(spec.start).cast("date"), F.lit(spec.end).cast("date"))
    )
    if name == "final" and policy.exclude_from_final:
        kept = kept.filter(~F.col("patch_id").isin(*policy.exclude_from_final))
    return kept


def cell_disjoint(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates outside every cell a used row lies in."""
    return candidates.join(used.select("spatial_group").distinct(), "spatial_group", "left_anti")


def spatially_eligible(candidates: DataFrame, used: DataFrame | None, policy: Policy) -> DataFrame:
    if used is None:
        return candidates
    left = cell_disjoint(candidates, used).withColumn("left_id", F.col("patch_id"))
    return guard_band(left, used, policy.minimum_center_distance_m).drop("left_id")


def grid_dedupe(candidates: DataFrame, seed: int) -> DataFrame:
    """One observation per grid key: the first in hashed order, as a min of structs."""
    order = hashed_order(seed, F.col("patch_id"))
    columns = [c for c in candidates.columns]
    first = candidates.groupBy(patch_grid(F.col("patch_id")).alias("grid")).agg(
        F.min_by(F.struct(*columns), order).alias("row")
    )
    return first.select("row.*")


def allocate_cells(
    unique: DataFrame, labels: Sequence[str], size: int, policy: Policy, is_index: bool
) -> DataFrame:
    """Cells a partition owns, in hashed order: (spatial_group, cell_order, n).

    Rare labels claim cells first. The other cells follow in hashed order as long as cells
    or patches are short, which running sums decide; the Earth's surface bounds the cells.
    """
    cells = claims.cell_gains(unique).withColumn("cell_order", hashed_order(policy.seed, F.col("spatial_group")))
    if is_index:
        return cells.drop("gains")
    cells = cut_lineage(cells)
    ordered = claims.rare_first(labels, claims.label_totals(unique))
    owners = claims.claim_cells(cells, "cell_order", ordered, policy.minimum_label_count)
    claimed = unique.sparkSession.createDataFrame([(name,) for name in owners], "claimed string")
    marked = cells.join(claimed, F.col("spatial_group") == F.col("claimed"), "left").withColumn(
        "open", F.col("claimed").isNull()
    )
    everywhere = Window.partitionBy()
    ahead = Window.orderBy(~F.col("open"), "cell_order").rowsBetween(Window.unboundedPreceding, -1)
    cells_so_far = F.count_if(~F.col("open")).over(everywhere) + F.coalesce(F.count_if("open").over(ahead), F.lit(0))
    patches_so_far = F.coalesce(
        F.sum(F.when(~F.col("open"), F.col("n"))).over(everywhere), F.lit(0)
    ) + F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))).over(ahead), F.lit(0))
    short = (cells_so_far < policy.minimum_query_cells) | (patches_so_far < size)
    owned = cut_lineage(
        marked.withColumn("needed", ~F.col("open") | short).filter("needed").select("spatial_group", "cell_order", "n")
    )
    n_cells, n_patches = owned.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_cells < policy.minimum_query_cells:
        raise ValueError(f"{n_cells} cells are left, {policy.minimum_query_cells} are asked for")
    if not n_cells <= size <= n_patches:
        raise ValueError(f"{size} patches cannot be drawn from {n_cells} cells with {n_patches} patches")
    return owned


def fill_partition(
    unique: DataFrame, cells: DataFrame, labels: Sequence[str], size: int, policy: Policy
) -> DataFrame:
    """First patch of each owned cell, label top-up, then round-robin to ``size``."""
    pool = unique.join(cells.select("spatial_group", "cell_order"), "spatial_group").withColumn(
        "patch_order", hashed_order(policy.seed, F.col("patch_id"))
    )
    pool = cut_lineage(
        hashed_rank(pool, ["spatial_group"], "patch_order", rank="offset", size="__size").drop("__size")
    )
    first = pool.filter("offset = 1")
    ordered = claims.rare_first(labels, claims.label_totals(unique))
    added = claims.top_up(
        pool, F.col("offset") > 1, "patch_id", "patch_order", ordered, claims.label_totals(first),
        policy.minimum_label_count,
    )
    extra = pool.sparkSession.createDataFrame([(name,) for name in added], "patch_id string")
    taken = cut_lineage(first.select("patch_id").unionByName(extra))
    n_taken = taken.count()
    if n_taken > size:
        raise ValueError(f"cells and labels need {n_taken} patches, {size} are allowed")
    left = pool.join(taken, "patch_id", "left_anti")
    rounds = bucketed_rank(
        left.withColumn("__all", F.lit(0)), ["__all"], "offset", ["cell_order"], "turn", "__left"
    )
    filled = rounds.filter(F.col("turn") <= size - n_taken).select("patch_id")
    chosen = taken.unionByName(filled)
    return unique.join(chosen, "patch_id", "left_semi")


@dataclass(frozen=True)
class Selection:
    """Selected rows per partition and how many rows were eligible for each."""

    rows: DataFrame
    feasibility: DataFrame


def select_partitions(candidates: DataFrame, policy: Policy) -> Selection:
    """Draw the partitions in order, each clear of the cells and distance of earlier ones."""
    labels = claims.label_domain(candidates)
    selected: DataFrame | None = None
    feasible: DataFrame | None = None
    for name in policy.order:
        spec = policy.partitions[name]
        timely = window_filter(candidates, name, policy)
        eligible = cut_lineage(spatially_eligible(timely, selected, policy))
        counts = beside(
            eligible.agg(
                F.count(F.lit(1)).alias("after_spatial_filter"),
                F.count_distinct("spatial_group").alias("available_cells"),
            ),
            timely.agg(F.count(F.lit(1)).alias("after_temporal_filter")),
        )
        counts = counts.withColumn("partition", F.lit(name))
        feasible = counts if feasible is None else feasible.unionByName(counts)
        unique = grid_dedupe(eligible, policy.seed)
        cells = allocate_cells(unique, labels, spec.size, policy, name == "index")
        chosen = fill_partition(unique, cells, labels, spec.size, policy).withColumn(
            "partition", F.lit(name)
        )
        chosen = cut_lineage(chosen)
        selected = chosen if selected is None else selected.unionByName(chosen)
    return Selection(rows=selected, feasibility=feasible)


def with_corner_distance(rows: DataFrame) -> DataFrame:
    """Four rows per patch: metres from its centre to each reprojected corner."""
    corners = F.array(*[
        F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("left", "right") for y in ("bottom", "top")
    ])
    exploded = rows.withColumn("corner", F.explode(corners))
    placed = add_lonlat(
        exploded, F.col("epsg"), F.col("corner.x"), F.col("corner.y"), "corner_lon", "corner_lat"
    )
    return placed.withColumn(
        "corner_m",
        haversine_m(F.col("corner_lon"), F.col("corner_lat"), F.col("longitude"), F.col("latitude")),
    )


def partition_stats(rows: DataFrame) -> DataFrame:
    """Size, cells, dates and the largest corner radius of every partition."""
    day = patch_day(F.col("patch_id"))
    return with_corner_distance(rows).groupBy("partition").agg(
        F.expr("count(*) div 4").alias("patches"),
        F.count_distinct("spatial_group").alias("cells"),
        F.min(day).alias("date_min"),
        F.max(day).alias("date_max"),
        F.max("corner_m").alias("maximum_corner_radius_m"),
    )


def pairwise_separation(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Shared cells, centre distance, footprint bound and day gap of each pair."""
    stats = partition_stats(rows)
    measured = None
    for i, left in enumerate(names):
        for right in names[i + 1 :]:
            a = rows.filter(F.col("partition") == left).withColumn("left_id", F.col("patch_id"))
            b = rows.filter(F.col("partition") == right)
            center = nearest_distance(a, b).agg(F.min("nearest_m").alias("minimum_center_distance_m"))
            shared = (
                a.select("spatial_group").distinct()
                .join(b.select("spatial_group").distinct(), "spatial_group")
                .agg(F.count(F.lit(1)).alias("shared_cells"))
            )
            pair = beside(center, shared).select(
                F.lit(left).alias("left_partition"), F.lit(right).alias("right_partition"), "*"
            )
            measured = pair if measured is None else measured.unionByName(pair)
    lefts = stats.select(F.col("partition").alias("left_partition"),
                         F.col("date_max").alias("__end"),
                         F.col("maximum_corner_radius_m").alias("__lr"))
    rights = stats.select(F.col("partition").alias("right_partition"),
                          F.col("date_min").alias("__start"),
                          F.col("maximum_corner_radius_m").alias("__rr"))
    return (
        measured.join(lefts, "left_partition")
        .join(rights, "right_partition")
        .select(
            "left_partition", "right_partition", "shared_cells", "minimum_center_distance_m",
            (F.col("minimum_center_distance_m") - 1.01 * (F.col("__lr") + F.col("__rr"))).alias(
                "footprint_separation_lower_bound_m"
            ),
            F.datediff("__start", "__end").alias("temporal_gap_days"),
        )
    )


def audit_selection(rows: DataFrame, candidates: DataFrame, policy: Policy) -> DataFrame:
    """Violations of a selection, recomputed from candidate rows only.

    ``rows`` has (patch_id, partition); everything else comes from ``candidates``.
    """
    # A selection is as small as its policy says; it is written once and then read
    # by every rule below.
    bound = cut_lineage(rows.select("patch_id", "partition").join(candidates, "patch_id", "left"))
    day = patch_day(F.col("patch_id"))
    in_window = F.lit(False)
    for name, spec in policy.partitions.items():
        in_window = in_window | (
            (F.col("partition") == name)
            & (F.col("split") == spec.official_split)
            & day.between(F.lit(spec.start).cast("date"), F.lit(spec.end).cast("date"))
        )
    row_rules = violations(
        bound, "patch_id",
        [
            Rule("absent_from_metadata", F.col("split").isNull()),
            Rule("outside_split_or_window", ~F.coalesce(in_window, F.lit(False))),
            Rule("excluded_patch", F.coalesce(
                F.col("contains_seasonal_snow") | F.col("contains_cloud_or_shadow"), F.lit(False))),
            Rule("previously_inspected", (F.col("partition") == "final")
                 & F.col("patch_id").isin(*policy.exclude_from_final or [""])),
        ],
    )
    repeats = rows.groupBy("patch_id").count().filter("count > 1").select(
        F.lit("repeated_identity").alias("rule"), F.col("patch_id").alias("key"))
    grids = rows.groupBy("partition", patch_grid(F.col("patch_id")).alias("grid")).count().filter(
        "count > 1").select(F.lit("repeated_grid").alias("rule"), F.col("grid").alias("key"))
    spark = rows.sparkSession
    wanted = spark.createDataFrame(
        [(n, s.size, 0 if n == "index" else policy.minimum_query_cells)
         for n, s in policy.partitions.items()], "partition string, size bigint, least bigint")
    sized = bound.groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("spatial_group").alias("cells"))
    joined = wanted.join(sized, "partition", "left").fillna(0, ["n", "cells"])
    sizes = joined.filter("n <> size").select(F.lit("partition_size").alias("rule"), F.col("partition").alias("key"))
    cells = joined.filter("cells < least").select(F.lit("too_few_cells").alias("rule"), F.col("partition").alias("key"))
    domain = candidates.select(F.explode("labels").alias("label")).distinct()
    names = F.array(*[F.lit(name) for name in policy.partitions])
    grid = domain.select(F.explode(names).alias("partition"), "label")
    have = bound.select("partition", F.explode("labels").alias("label")).groupBy("partition", "label").agg(
        F.count(F.lit(1)).alias("n"))
    labels = grid.join(have, ["partition", "label"], "left").filter(
        F.coalesce("n", F.lit(0)) < policy.minimum_label_count
    ).select(F.lit("label_minimum").alias("rule"), F.concat_ws("/", "partition", "label").alias("key"))
    pairs = pairwise_separation(bound, list(policy.partitions))
    pair = F.concat_ws("/", "left_partition", "right_partition").alias("key")
    separated = violations(
        pairs.withColumn("pair", pair), "pair",
        [
            Rule("cells_overlap", F.col("shared_cells") > 0),
            Rule("center_distance", F.col("minimum_center_distance_m") < policy.minimum_center_distance_m),
            Rule("footprint_bound", F.col("footprint_separation_lower_bound_m")
                 < policy.minimum_footprint_separation_m),
            Rule("temporal_gap", F.col("temporal_gap_days") < policy.minimum_temporal_gap_days),
        ],
    )
    return stack(row_rules, repeats, grids, sizes, cells, labels, separated)


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.select("partition", F.explode("labels").alias("label")).groupBy("partition", "label").agg(
        F.count(F.lit(1)).alias("patches"))


def geometry_disagreements(reloaded: DataFrame, inventory: DataFrame) -> DataFrame:
    """Patches whose independently read geometry differs from the inventory."""
    fields = ("epsg", "left", "bottom", "right", "top")
    other = inventory.select("patch_id", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__in"))
    joined = reloaded.select("patch_id", *fields).join(other, "patch_id", "left")
    differs = F.col("__in").isNull()
    for c in fields:
        differs = differs | ~(F.col(c).eqNullSafe(F.col(f"__{c}")))
    return joined.filter(differs).select(
        "patch_id",
        F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in fields]).alias("fields"),
    )
