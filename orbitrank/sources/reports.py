"""Report documents: written from tables, read back into tables, and the run log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitrank.functions.hashing import is_sha256
from orbitrank.sources.stores import KNOWN_BACKENDS

SECTIONS = ("aggregate", "agreement", "geographic", "distance", "failures")
REPORT_SCHEMA = """
k int, aggregate map<string, struct<map_at_k: double>>,
agreement struct<queries: bigint, pairwise_overlap: map<string, struct<mean_overlap_at_k: double>>,
  all_stores_correct: bigint>,
geographic struct<spatial_group_spread: map<string, struct<standard_deviation: double, minimum: double, median: double>>>,
distance struct<quartiles: map<string, map<string, double>>, edges: map<string, array<double>>>,
failures struct<count: bigint>
"""


def keyed(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """One row holding a map from key to value; for keys bounded by the number of stores."""
    entries = F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value")))
    by_key = F.array_sort(
        entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    )
    return df.agg(F.map_from_entries(by_key).alias(name))


def report_document(sections: DataFrame) -> DataFrame:
    """Serialise a one-row table of sections with sorted keys."""
    ordered = F.struct(*[F.col(c) for c in sorted(sections.columns)])
    return sections.select(F.to_json(ordered).alias("value"))


def write_report(document: DataFrame, path: str) -> None:
    """Text sink of one document; the commit protocol makes it atomic."""
    document.write.mode("overwrite").text(path)


def read_report(documents: DataFrame) -> DataFrame:
    """Parse report text, requiring all five sections."""
    parsed = documents.select(F.from_json("value", REPORT_SCHEMA).alias("r")).select("r.*")
    missing = [F.when(F.col(s).isNull(), F.lit(s)) for s in SECTIONS]
    absent = F.concat_ws(", ", *missing)
    return parsed.filter(
        F.when(absent != "", F.raise_error(F.concat(F.lit("report lacks: "), absent))).otherwise(F.lit(True))
    )


def display_name(store: Column, names: Mapping[str, str]) -> Column:
    """Short name of a store; an unknown store keeps its recorded one."""
    if not names:
        return store
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, store), store)


def place_label(place_id: Column) -> Column:
    """Readable region of a place id: its last segment dropped, first letter raised."""
    parts = F.split(place_id, "-")
    region = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " ")).otherwise(place_id)
    return F.concat(F.upper(F.substring(region, 1, 1)), F.substr(region, F.lit(2)))


def findings_series(report: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """One row per store for the page, best mean average precision first."""
    stores = report.select(
        F.explode("aggregate").alias("store", "a"), "geographic", "distance", "k"
    )
    spread = F.col("geographic.spatial_group_spread")[F.col("store")]
    quartiles = F.col("distance.quartiles")[F.col("store")]
    return stores.select(
        display_name(F.col("store"), names).alias("key"),
        F.col("a.map_at_k").alias("map"),
        spread["standard_deviation"].alias("sd"),
        spread["minimum"].alias("min"),
        spread["median"].alias("med"),
        *[quartiles[f"q{i}"].alias(f"q{i}") for i in range(1, 5)],
    ).orderBy(F.desc("map"))


def findings_edges(report: DataFrame) -> DataFrame:
    """Quartile edges in km, one decimal, half to even."""
    edges = F.element_at(F.map_values("distance.edges"), 1)
    return report.select(F.posexplode(F.transform(edges, lambda m: F.bround(m / 1000, 1))).alias("edge", "km"))


def findings_places(survey: DataFrame) -> DataFrame:
    return survey.select(
        place_label(F.col("place_id")).alias("label"), "place_id", "latitude", F.col("distinct_days").alias("days")
    ).orderBy("latitude")


def headline(report: DataFrame, places: DataFrame) -> DataFrame:
    """The figures stated in prose, from the same payload."""
    from orbitrank.operators.frames import beside

    best = F.array_max(F.transform(F.map_values("agreement.pairwise_overlap"), lambda v: v["mean_overlap_at_k"]))
    queries = F.greatest(F.coalesce("agreement.queries", F.lit(0)), F.lit(1))
    stated = report.select(
        F.format_string("%.0f of %d", F.bround(F.coalesce(best, F.lit(0.0)) * F.col("k")), F.col("k")).alias("best_overlap"),
        F.bround(F.col("agreement.all_stores_correct") / queries * 100, 1).alias("all_correct_pct"),
    )
    days = places.agg(
        F.coalesce(F.max("days"), F.lit(0)).alias("days_max"), F.coalesce(F.min("days"), F.lit(0)).alias("days_min")
    )
    return beside(stated, days)


def evaluation_parameters(meta: DataFrame) -> DataFrame:
    """Allow-listed parameters: unknown backends become custom, malformed hashes vanish."""
    def digest(c: Column) -> Column:
        return F.when(is_sha256(c), F.lower(c))

    backend = F.when(F.col("backend").isin(*KNOWN_BACKENDS), F.col("backend")).otherwise("custom")
    return meta.select(
        "store", backend.alias("backend"),
        digest(F.col("manifest_sha256")).alias("manifest_sha256"),
        digest(F.col("metadata")["checkpoint_sha256"]).alias("checkpoint_sha256"),
        F.lit("exact-cosine").alias("ranker"), F.lit("class-label-proxy").alias("relevance"),
    )


def append_run(parameters: DataFrame, metrics: DataFrame, path: str) -> None:
    """Append one run per store to the log table."""
    parameters.join(metrics, "store").write.mode("append").parquet(path)
