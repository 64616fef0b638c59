"""Same-place observations over time: surveys, date choice and guarded splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbitrank.functions.geo import bbox_defect, place_bbox
from orbitrank.operators.checks import Rule, duplicates, enforce, violations
from orbitrank.operators.frames import stack

MINIMUM_DATES = 2
UNKNOWN_DAY = "unknown"
#: Degrees of a tile on level 0, which holds any box, and the level of the finest tiles.
WIDEST_TILE, FINEST_LEVEL = 512, 20


def place_violations(places: DataFrame) -> DataFrame:
    """Unsafe or repeated ids, coordinates out of range, an empty list."""
    pid, lon, lat = F.col("place_id"), F.col("longitude"), F.col("latitude")
    rows = violations(
        places, "place_id",
        [
            Rule("unsafe_place_id", F.coalesce(pid, F.lit("")).rlike(r"^$|[/\\]")),
            Rule("longitude_out_of_range", lon.isNull() | F.isnan(lon) | (F.abs(lon) > 180)),
            Rule("latitude_out_of_range", lat.isNull() | F.isnan(lat) | (F.abs(lat) > 85)),
        ],
    )
    none = places.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("no_places").alias("rule"), F.lit("all").alias("key")
    )
    return stack(rows, duplicates(places, "place_id", "duplicate_place_id"), none)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """place_id, longitude, latitude and note of a places file: a JSON list of objects.

    Raises if an entry is not usable, if ids repeat and if there is none.
    """
    schema = "place_id string, longitude double, latitude double, note string"
    places = spark.read.schema(schema).option("multiLine", True).json(path)
    places = places.withColumn("note", F.coalesce("note", F.lit("")))
    enforce(place_violations(places))
    return places


def with_windows(places: DataFrame, size_m: float) -> DataFrame:
    """Add the search window of every place."""
    if not size_m > 0:
        raise ValueError("a window has an extent above zero metres")
    west, south, east, north = place_bbox(F.col("longitude"), F.col("latitude"), size_m)
    return places.withColumns({"west": west, "south": south, "east": east, "north": north})


def window_violations(windows: DataFrame) -> DataFrame:
    """Places whose search window leaves the globe or crosses the antimeridian."""
    sides = [F.col(c) for c in ("west", "south", "east", "north")]
    return windows.select(F.col("place_id").alias("key"), bbox_defect(*sides).alias("defect")).filter(
        F.col("defect").isNotNull()
    ).select(F.concat(F.lit("window_"), F.col("defect")).alias("rule"), "key")


def _levels(df: DataFrame, prefix: str) -> DataFrame:
    """Add ``own``: the finest level whose tiles are no smaller than the row's box."""
    extent = F.greatest(F.col(f"{prefix}east") - F.col(f"{prefix}west"), F.col(f"{prefix}north") - F.col(f"{prefix}south"))
    fitting = F.floor(F.log2(WIDEST_TILE / F.greatest(extent, F.lit(WIDEST_TILE / 2.0**FINEST_LEVEL))))
    return df.withColumn(f"{prefix}own", F.greatest(fitting, F.lit(0)).cast("int"))


def _own_levels(df: DataFrame, column: str) -> list[int]:
    return sorted(row[0] for row in df.select(column).distinct().collect() if row[0] is not None)  # at most all levels


def _tiles(df: DataFrame, prefix: str, others: Sequence[int]) -> DataFrame:
    """A row for each tile that a box touches on its own level and on the coarser ones of ``others``."""
    own = F.col(f"{prefix}own")
    coarser = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda level: level < own)
    placed = df.withColumn("level", F.explode(F.concat(F.array(own), coarser)))
    side = F.lit(float(WIDEST_TILE)) / F.pow(F.lit(2.0), F.col("level"))
    for axis, low, high in (("tile_x", "west", "east"), ("tile_y", "south", "north")):
        ends = (F.floor(F.col(f"{prefix}{end}") / side) for end in (low, high))
        placed = placed.withColumn(axis, F.explode(F.sequence(*ends)))
    return placed


def items_in_windows(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Catalogue items whose box overlaps a place's window.

    Tiles are halved level by level. A box belongs to the finest level whose tiles are no
    smaller than it, where it touches four tiles at most; wide boxes stay on coarse levels.
    Two boxes meet on the coarser of their two levels: each is keyed by its own level and
    by the coarser ones that the other side has boxes on. Both sides meet by equi-join; the
    exact four-way test follows, counted at the first shared tile only.
    """
    left = _levels(windows, "")
    right = _levels(items.withColumnsRenamed({c: f"i_{c}" for c in ("west", "south", "east", "north")}), "i_")
    left_levels, right_levels = _own_levels(left, "own"), _own_levels(right, "i_own")
    overlap = (
        (F.col("west") <= F.col("i_east")) & (F.col("east") >= F.col("i_west"))
        & (F.col("south") <= F.col("i_north")) & (F.col("north") >= F.col("i_south"))
    )
    side = F.lit(float(WIDEST_TILE)) / F.pow(F.lit(2.0), F.col("level"))
    first = (
        (F.col("level") == F.least("own", "i_own"))
        & (F.col("tile_x") == F.floor(F.greatest("west", "i_west") / side))
        & (F.col("tile_y") == F.floor(F.greatest("south", "i_south") / side))
    )
    met = _tiles(left, "", right_levels).join(_tiles(right, "i_", left_levels), ["level", "tile_x", "tile_y"])
    return met.filter(overlap & first).drop("level", "tile_x", "tile_y", "own", "i_own")


def acquisition_day(timestamp: Column) -> Column:
    """Day text of an acquisition; a missing time is its own day."""
    return F.coalesce(F.date_format(timestamp, "yyyy-MM-dd"), F.lit(UNKNOWN_DAY))


def day_dedupe(items: DataFrame) -> DataFrame:
    """One observation per place and day: least cloudy, then earliest, then lowest id.

    The choice is a ``min_by`` over structs, so it combines before the shuffle and a
    crowded day costs one row per task.
    """
    cloud = F.coalesce("cloud", F.lit(float("inf")))
    order = F.struct(cloud, F.coalesce(F.col("datetime").cast("string"), F.lit("")), F.col("item_id"))
    rest = F.struct(*[c for c in items.columns if c != "place_id"])
    return (
        items.groupBy("place_id", acquisition_day(F.col("datetime")).alias("acquisition_day"))
        .agg(F.min_by(rest, order).alias("row"), F.count(F.lit(1)).alias("items_that_day"))
        .select("place_id", "acquisition_day", "row.*", "items_that_day")
    )


def place_survey(places: DataFrame, observations: DataFrame) -> DataFrame:
    """Items, distinct days and usability of every place, also where nothing was found."""
    found = observations.groupBy("place_id").agg(
        F.sum("items_that_day").alias("items_returned"),
        F.count(F.lit(1)).alias("distinct_days"),
        F.min("acquisition_day").alias("first_day"),
        F.max("acquisition_day").alias("last_day"),
    )
    known = places.select("place_id").distinct().join(found, "place_id", "left")
    return known.fillna(0, ["items_returned", "distinct_days"]).select(
        "place_id", "items_returned", "distinct_days",
        (F.col("distinct_days") >= MINIMUM_DATES).alias("usable"), "first_day", "last_day",
    )


#: What a survey tells of an observation beside its day, where the items have it.
OBSERVED = ("item_id", "datetime", "cloud", "grid_code", "relative_orbit", "sun_elevation")


def survey_report(places: DataFrame, observations: DataFrame) -> DataFrame:
    """``place_survey`` with each place's facts and its observations, a struct for each day, in order.

    A list has at most one entry for each calendar day of one place.
    """
    told = [c for c in OBSERVED if c in observations.columns]
    listed = observations.groupBy("place_id").agg(
        F.array_sort(F.collect_list(F.struct("acquisition_day", *told))).alias("observations")
    )
    entry = dict(observations.select("acquisition_day", *told).dtypes)
    kind = "array<struct<" + ",".join(f"{name}:{entry[name]}" for name in ("acquisition_day", *told)) + ">>"
    facts = places.select("place_id", *[c for c in ("longitude", "latitude", "note") if c in places.columns])
    return (
        facts.join(place_survey(places, observations), "place_id").join(listed, "place_id", "left")
        .withColumn("observations", F.coalesce("observations", F.array().cast(kind)))
    )


def observe_places(places: DataFrame, items: DataFrame, size_m: float) -> DataFrame:
    """From places to their days: the least cloudy item of each day in each place's window.

    items: item_id, datetime, cloud and the box (west, south, east, north). Raises if a
    window leaves the globe.
    """
    windows = with_windows(places, size_m)
    enforce(window_violations(windows))
    found = items_in_windows(windows.select("place_id", "west", "south", "east", "north"), items)
    return day_dedupe(found.drop("west", "south", "east", "north", *[f"i_{c}" for c in ("west", "south", "east", "north")]))


def upper_median(values: Column) -> Column:
    """Element at position n // 2 of the sorted values, not the interpolated median."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def survey_totals(survey: DataFrame) -> DataFrame:
    """Totals over places; the list of counts is one small integer per place."""
    days = F.col("distinct_days")
    counted = survey.groupBy(days).agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("usable"))
    before = Window.orderBy("distinct_days").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    placed = counted.withColumns({
        "before": F.coalesce(F.sum("n").over(before), F.lit(0)), "places": F.sum("n").over(everywhere)
    })
    middle = F.floor(F.col("places") / 2)
    return placed.agg(
        F.sum("n").alias("places"),
        F.sum("usable").alias("usable_places"),
        F.min(days).alias("minimum"),
        F.max(F.when((F.col("before") <= middle) & (middle < F.col("before") + F.col("n")), days)).alias("median"),
        F.max(days).alias("maximum"),
        F.sum(days * F.col("n")).alias("total"),
    )


def place_days(observations: DataFrame) -> DataFrame:
    """Sorted distinct days per place as day numbers; the calendar bounds the array."""
    known = observations.filter(F.col("acquisition_day") != UNKNOWN_DAY)
    number = F.unix_date(F.to_date("acquisition_day"))
    return known.groupBy("place_id").agg(F.array_sort(F.collect_set(number)).alias("days"))


def select_dates(days: DataFrame, max_dates: int) -> DataFrame:
    """Up to ``max_dates`` days spread evenly between first and last, as sorted day numbers.

    Every slot takes the nearest unused day, the earlier one on a tie. One slot
    takes the first day.
    """
    if max_dates < 1:
        raise ValueError("at least one date is chosen")
    first, last = F.element_at("days", 1), F.element_at("days", -1)

    def add(chosen: Column, slot: Column) -> Column:
        target = first + (last - first) * slot / max(max_dates - 1, 1)
        ranked = F.transform(
            F.array_except("days", chosen),
            lambda day: F.struct(F.abs(day - target).alias("gap"), day.alias("day")),
        )
        return F.array_append(chosen, F.array_min(ranked)["day"])

    spread = F.aggregate(
        F.sequence(F.lit(0), F.lit(max_dates - 1)), F.array().cast("array<int>"), add
    )
    chosen = F.when(F.size("days") <= max_dates, F.col("days")).otherwise(F.array_sort(spread))
    return days.withColumn("days", chosen)


def choose_queries(days: DataFrame, count: int) -> DataFrame:
    """Hold out ``count`` days spread through each place's own timeline.

    Places with no more than ``count`` days leave no index and are dropped.
    """
    if count < 1:
        raise ValueError("at least one query is held out")
    n = F.size("days")
    slots = F.array(*[F.lit(slot + 0.5) for slot in range(count)])
    positions = F.array_distinct(
        F.transform(slots, lambda s: F.least(F.floor(s * n / count).cast("int"), n - 1))
    )
    held = F.transform(positions, lambda p: F.get(F.col("days"), p))
    return days.filter(n > count).select(
        "*", F.array_sort(held).alias("query_days"),
        F.array_sort(F.array_except(F.col("days"), held)).alias("index_days"),
    )


def to_rows(days: DataFrame, column: str, role: str) -> DataFrame:
    dates = F.transform(column, F.date_from_unix_date)
    return days.select(
        "place_id", F.explode(dates).alias("acquisition_day"), F.lit(role).alias("split")
    )


def nearest_gap(day: Column, others: Column) -> Column:
    """Smallest distance in days from one day number to an array of them."""
    return F.array_min(F.transform(others, lambda other: F.abs(other - day)))


def day_gap(chosen: DataFrame) -> DataFrame:
    """Days from every query acquisition to its place's nearest index acquisition."""
    exploded = chosen.withColumn("day", F.explode("query_days"))
    return exploded.select(
        "place_id", F.date_from_unix_date("day").alias("acquisition_day"),
        nearest_gap(F.col("day"), F.col("index_days")).alias("day_gap_to_nearest_index"),
    )


def gap_to_marked(number: Column, marked: Column, place: str = "place_id") -> Column:
    """Days from a day to its place's nearest marked one, itself included; NULL without any.

    The nearest earlier one is a running maximum over the place's days, the nearest later
    one a running minimum backwards.
    """
    day = F.when(marked, number)
    earlier = Window.partitionBy(place).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(place).orderBy(number.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.least(number - F.max(day).over(earlier), F.min(day).over(later) - number)


def guarded_split(
    observations: DataFrame, anchor: str, query_count: int, min_day_gap: int
) -> DataFrame:
    """Role of every known day of a place: query, index or excluded.

    Queries are the days nearest ``anchor`` (the earlier on a tie); other days are
    index from ``min_day_gap`` days on, else excluded. ``gap_days`` is the distance
    to the other side, ``usable`` says whether the place keeps any index day. A
    place has at most one row per calendar day here, so its windows stay small.
    """
    if query_count < 1 or min_day_gap < 0:
        raise ValueError("query_count must be positive and min_day_gap not negative")
    known = observations.filter(F.col("acquisition_day") != UNKNOWN_DAY)
    days = known.select("place_id", F.to_date("acquisition_day").alias("acquisition_day")).distinct()
    number = F.unix_date("acquisition_day")
    place = Window.partitionBy("place_id")
    nearest = place.orderBy(F.abs(number - F.unix_date(F.lit(anchor).cast("date"))), number)
    ordered = days.withColumns({
        "number": number,
        "nth": F.row_number().over(nearest),
        "n": F.count(F.lit(1)).over(place),
    })
    query = (F.col("nth") <= query_count) & (F.col("n") >= 2)
    queried = ordered.withColumn("query", query)
    to_query = gap_to_marked(F.col("number"), F.col("query"))
    split = (
        F.when(F.col("query"), "query")
        .when((F.col("n") >= 2) & (F.col("to_query") >= min_day_gap), "index").otherwise("excluded")
    )
    placed = queried.withColumn("to_query", to_query).withColumn("split", split)
    is_index = F.col("split") == "index"
    gap = F.when(F.col("query"), gap_to_marked(F.col("number"), is_index)).otherwise(F.col("to_query"))
    return placed.select(
        "place_id", "acquisition_day", "split", gap.alias("gap_days"), F.max(is_index).over(place).alias("usable")
    )


def resplit_corpus(
    records: DataFrame, anchor: str, query_count: int, min_day_gap: int
) -> DataFrame:
    """Re-partition a corpus: the last record of each (place, day), usable places only.

    Query rows carry their recomputed gap; index rows carry none.
    """
    rest = F.struct(*[c for c in records.columns if c not in ("place_id", "acquisition_day", "split")])
    latest = records.groupBy("place_id", "acquisition_day").agg(
        F.max_by(rest, "item_id").alias("row")
    ).select("place_id", "acquisition_day", "row.*")
    text = records.withColumn("acquisition_day", F.date_format("acquisition_day", "yyyy-MM-dd"))
    roles = guarded_split(text, anchor, query_count, min_day_gap).filter(
        F.col("usable") & (F.col("split") != "excluded")
    )
    gap = F.when(F.col("split") == "query", F.col("gap_days"))
    return latest.join(
        roles.select("place_id", "acquisition_day", "split", gap.alias("day_gap_to_nearest_index")),
        ["place_id", "acquisition_day"],
    )


def resplit_report(split: DataFrame) -> DataFrame:
    """What each place kept, lost and how close its queries came."""
    def count(role: str) -> Column:
        return F.count_if(F.col("split") == role)

    closest = F.min(F.when(F.col("split") == "index", F.col("gap_days")))
    return split.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("available_days"),
        count("query").alias("queries"),
        count("index").alias("index_days"),
        count("excluded").alias("excluded_days"),
        F.coalesce(closest, F.lit(0)).alias("observed_min_gap_days"),
        (count("index") > 0).alias("usable"),
    )


def resplit_totals(corpus: DataFrame) -> DataFrame:
    """Corpus size and the minimum, upper median and maximum gap of its queries."""
    gap = F.col("day_gap_to_nearest_index")
    per_gap = corpus.groupBy("split", gap).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("split").orderBy("day_gap_to_nearest_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = per_gap.withColumns({
        "before": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "all": F.sum("n").over(Window.partitionBy("split")),
    })
    middle = F.floor(F.col("all") / 2)
    query = F.col("split") == "query"
    return placed.agg(
        F.sum("n").alias("images"),
        F.sum(F.when(~query, F.col("n"))).alias("index_items"),
        F.sum(F.when(query, F.col("n"))).alias("query_items"),
        F.min(F.when(query, gap)).alias("minimum"),
        F.max(F.when(query & (F.col("before") <= middle) & (middle < F.col("before") + F.col("n")), gap)).alias("median"),
        F.max(F.when(query, gap)).alias("maximum"),
    )


def temporal_corpus(
    observations: DataFrame, max_dates: int, query_dates: int
) -> tuple[DataFrame, DataFrame]:
    """Plan a corpus: chosen observations with their split, and places that cannot join.

    Gaps count the planned index days, whether or not their chip is ever written.
    """
    days = select_dates(place_days(observations), max_dates)
    failures = days.filter(F.size("days") < MINIMUM_DATES).select(
        "place_id", F.lit("fewer than two dates").alias("reason")
    )
    chosen = choose_queries(days.filter(F.size("days") >= MINIMUM_DATES), query_dates)
    roles = stack(to_rows(chosen, "query_days", "query"), to_rows(chosen, "index_days", "index"))
    roles = roles.join(day_gap(chosen), ["place_id", "acquisition_day"], "left")
    source = observations.filter(F.col("acquisition_day") != UNKNOWN_DAY).withColumn(
        "acquisition_day", F.to_date("acquisition_day")
    )
    corpus = source.join(roles, ["place_id", "acquisition_day"]).withColumnRenamed(
        "item_id", "source_item_id"
    ).withColumn("item_id", F.concat_ws("/", "place_id", F.date_format("acquisition_day", "yyyy-MM-dd")))
    return corpus, failures


def corpus_report(observations: DataFrame, max_dates: int, corpus: DataFrame) -> DataFrame:
    """What each place of a corpus had, was chosen and has written, with its query days.

    ``corpus`` are the written records (place_id, acquisition_day, split): a plan's, or what
    came of it. Places of which nothing was planned are among the plan's failures.
    """
    days = select_dates(place_days(observations), max_dates).filter(F.size("days") >= MINIMUM_DATES)
    known = observations.filter(F.col("acquisition_day") != UNKNOWN_DAY)
    available = known.groupBy("place_id").agg(F.count_distinct("acquisition_day").alias("available_days"))
    written = corpus.groupBy("place_id").agg(
        F.count_distinct("acquisition_day").alias("written"),
        F.array_sort(F.collect_set(F.when(F.col("split") == "query", F.col("acquisition_day")))).alias("queries"),
    )
    day = lambda place: F.date_from_unix_date(F.element_at("days", place))
    return days.join(available, "place_id").join(written, "place_id").select(
        "place_id", "available_days", F.size("days").cast("bigint").alias("selected_days"), "written", "queries",
        day(1).alias("first_day"), day(-1).alias("last_day"),
    )
