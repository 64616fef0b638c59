"""Registered queries over places and their acquisitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitrank.operators import temporal
from orbitrank.plans.bindings import SQL_ACQUISITIONS, SQL_PLACES, acquisitions, places, read, written, with_sql
from orbitrank.plans.registry import Registry, rounded
from orbitrank.session import scratch_path

REGISTRY = Registry()
QUERIES, ORACLES, register = REGISTRY.queries, REGISTRY.oracles, REGISTRY.add

MAX_DATES, QUERY_DATES = 4, 1
ANCHOR, QUERY_COUNT, MIN_GAP = "1998-07-15", 3, 90


def observations(spark, sf_dir):
    return written(spark, "observations", lambda: temporal.day_dedupe(acquisitions(spark, sf_dir)))


def dates(column):
    return F.array_join(F.transform(column, lambda d: F.date_format(F.date_from_unix_date(d), "yyyy-MM-dd")), ",")


SQL_DAYS = SQL_ACQUISITIONS + """,
days AS (SELECT DISTINCT place_id, CAST(acquisition_day AS DATE) AS day FROM obs WHERE acquisition_day <> 'unknown'),
extent AS (SELECT place_id, min(day) AS f, max(day) AS l, count(*) AS n FROM days GROUP BY place_id)"""


def _slot(i: int) -> str:
    before = "".join(f" UNION ALL SELECT place_id, day FROM slot{j}" for j in range(i))
    used = f"(SELECT place_id, day FROM days WHERE FALSE{before})"
    return f"""slot{i} AS (SELECT d.place_id, d.day FROM days d JOIN extent e USING (place_id)
  WHERE NOT EXISTS (SELECT 1 FROM {used} u WHERE u.place_id = d.place_id AND u.day = d.day)
  QUALIFY row_number() OVER (PARTITION BY d.place_id ORDER BY abs((d.day - e.f) - (e.l - e.f) * {i} / {MAX_DATES - 1}.0), d.day) = 1)"""


SQL_CHOSEN = SQL_DAYS + ",\n" + ",\n".join(_slot(i) for i in range(MAX_DATES)) + """,
chosen AS (""" + " UNION ALL ".join(f"SELECT * FROM slot{i}" for i in range(MAX_DATES)) + """),
ordered AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY day) - 1 AS p, count(*) OVER (PARTITION BY place_id) AS n FROM chosen),
roles AS (SELECT place_id, day, CASE WHEN p = CAST(floor(0.5 * n / 1) AS BIGINT) THEN 'query' ELSE 'index' END AS split FROM ordered),
gaps AS (SELECT q.place_id, q.day, min(abs(q.day - i.day)) AS gap FROM roles q JOIN roles i USING (place_id)
  WHERE q.split = 'query' AND i.split = 'index' GROUP BY ALL)"""

SQL_GUARD = SQL_DAYS + f""",
near AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY abs(day - DATE '{ANCHOR}'), day) AS r FROM days),
q AS (SELECT place_id, day FROM near WHERE r <= {QUERY_COUNT}),
others AS (SELECT n.place_id, n.day, min(abs(n.day - q.day)) AS gap FROM near n JOIN q USING (place_id) WHERE n.r > {QUERY_COUNT} GROUP BY ALL),
roles AS (SELECT place_id, day, 'query' AS split FROM q
  UNION ALL SELECT place_id, day, CASE WHEN gap >= {MIN_GAP} THEN 'index' ELSE 'excluded' END FROM others),
gaps AS (SELECT a.place_id, a.day, min(abs(a.day - b.day)) AS gap FROM roles a JOIN roles b USING (place_id)
  WHERE a.split = 'query' AND b.split = 'index' GROUP BY ALL)"""


@register(
    "places_read",
    with_sql(SQL_PLACES) + """, p AS (SELECT CASE WHEN key % 11 = 3 THEN 'a/b' WHEN key % 7 = 5 THEN 'same' ELSE place_id END AS place_id,
  CASE WHEN key % 13 = 4 THEN longitude + 400 ELSE longitude END AS longitude, CASE WHEN key % 9 = 2 THEN 86.0 ELSE latitude END AS latitude FROM places)
SELECT 'unsafe_place_id' AS rule, place_id AS key FROM p WHERE place_id LIKE '%/%'
UNION ALL SELECT 'longitude_out_of_range', place_id FROM p WHERE abs(longitude) > 180
UNION ALL SELECT 'latitude_out_of_range', place_id FROM p WHERE abs(latitude) > 85
UNION ALL SELECT 'duplicate_place_id', place_id FROM p GROUP BY place_id HAVING count(*) > 1""",
)
def q_places(spark, sf_dir):
    k = F.col("key")
    damaged = places(spark, sf_dir).withColumns({
        "place_id": F.when(k % 11 == 3, "a/b").when(k % 7 == 5, "same").otherwise(F.col("place_id")),
        "longitude": F.when(k % 13 == 4, F.col("longitude") + 400).otherwise(F.col("longitude")),
        "latitude": F.when(k % 9 == 2, 86.0).otherwise(F.col("latitude")),
    })
    return temporal.place_violations(damaged)


@register(
    "place_bbox",
    with_sql(SQL_PLACES) + """, h AS (SELECT *, 20000.0 / 2 / 111320.0 AS half FROM places)
SELECT place_id, round(longitude - half / cos(radians(latitude)), 6) AS west, round(latitude - half, 6) AS south,
  round(longitude + half / cos(radians(latitude)), 6) AS east, round(latitude + half, 6) AS north FROM h""",
)
def q_bbox(spark, sf_dir):
    return rounded(temporal.with_windows(places(spark, sf_dir), 20_000.0).select("place_id", "west", "south", "east", "north"))


@register(
    "place_window_violations",
    with_sql(SQL_PLACES) + """, w AS (SELECT place_id, longitude + CASE key % 3 WHEN 0 THEN 0 WHEN 1 THEN 179.95 - longitude ELSE -179.95 - longitude END AS x,
  latitude + CASE WHEN key % 5 = 4 THEN 89.95 - latitude ELSE 0 END AS y, 20000.0 / 2 / 111320.0 AS half FROM places),
b AS (SELECT place_id, x - half / cos(radians(y)) AS west, x + half / cos(radians(y)) AS east, y - half AS south, y + half AS north FROM w)
SELECT CASE WHEN NOT (west >= -180 AND east <= 180) THEN 'window_longitude_order' ELSE 'window_latitude_order' END AS rule, place_id AS key
FROM b WHERE NOT (west >= -180 AND east <= 180 AND south >= -90 AND north <= 90)""",
)
def q_window_violations(spark, sf_dir):
    """Places moved to the antimeridian and to the pole."""
    k = F.col("key")
    moved = places(spark, sf_dir).withColumns({
        "longitude": F.when(k % 3 == 0, F.col("longitude")).when(k % 3 == 1, 179.95).otherwise(-179.95),
        "latitude": F.when(k % 5 == 4, 89.95).otherwise(F.col("latitude")),
    })
    return temporal.window_violations(temporal.with_windows(moved, 20_000.0))


def item_boxes(spark, sf_dir):
    """Catalogue items with a half-degree box around a customer-derived point."""
    key = F.col("c_custkey")
    lon = F.pmod(key * 7919, F.lit(3600)) / 10.0 - 180.0
    lat = F.pmod(key * 4729, F.lit(1400)) / 10.0 - 70.0
    return read(spark, sf_dir, "customer").select(
        key.cast("string").alias("item_id"), (lon - 4).alias("west"), (lat - 3).alias("south"),
        (lon + 4).alias("east"), (lat + 3).alias("north"),
    )


@register(
    "place_items",
    with_sql(SQL_PLACES) + """, w AS (SELECT place_id, 20000.0 / 2 / 111320.0 AS half, longitude AS x, latitude AS y FROM places),
i AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id, CAST((c_custkey * 7919 % 3600) / 10.0 - 180.0 AS DOUBLE) AS x, CAST((c_custkey * 4729 % 1400) / 10.0 - 70.0 AS DOUBLE) AS y FROM customer)
SELECT place_id, item_id FROM w JOIN i ON w.x - half / cos(radians(w.y)) <= i.x + 4 AND w.x + half / cos(radians(w.y)) >= i.x - 4
  AND w.y - half <= i.y + 3 AND w.y + half >= i.y - 3""",
)
def q_place_items(spark, sf_dir):
    windows = temporal.with_windows(places(spark, sf_dir), 20_000.0)
    return temporal.items_in_windows(windows, item_boxes(spark, sf_dir)).select("place_id", "item_id")


@register("day_dedupe", with_sql(SQL_ACQUISITIONS) + "SELECT place_id, acquisition_day, item_id, cloud, items_that_day FROM obs")
def q_dedupe(spark, sf_dir):
    found = temporal.day_dedupe(acquisitions(spark, sf_dir))
    return found.select("place_id", "acquisition_day", "item_id", "cloud", "items_that_day")


# Two places of the list have no item at all.
_SURVEY = """SELECT p.place_id, CAST(coalesce(sum(items_that_day), 0) AS BIGINT) AS items_returned, count(acquisition_day) AS distinct_days,
  count(acquisition_day) >= 2 AS usable, min(acquisition_day) AS first_day, max(acquisition_day) AS last_day
  FROM (SELECT 'nation_' || n_nationkey AS place_id FROM nation UNION ALL SELECT 'nowhere_' || r_regionkey FROM region WHERE r_regionkey < 2) p
  LEFT JOIN obs USING (place_id) GROUP BY p.place_id"""


def surveyed(spark, sf_dir):
    """The places of the survey: one a nation, and two that no item belongs to."""
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("place_id"))
    empty = read(spark, sf_dir, "region").filter("r_regionkey < 2").select(
        F.concat(F.lit("nowhere_"), F.col("r_regionkey").cast("string")).alias("place_id"))
    return nations.unionByName(empty)


@register("place_survey", with_sql(SQL_ACQUISITIONS) + _SURVEY)
def q_survey(spark, sf_dir):
    return temporal.place_survey(surveyed(spark, sf_dir), observations(spark, sf_dir))


@register(
    "survey_totals",
    with_sql(SQL_ACQUISITIONS) + f""", s AS ({_SURVEY})
SELECT count(*) AS places, count(*) FILTER (usable) AS usable_places, min(distinct_days) AS minimum,
  list_sort(list(distinct_days))[count(*) // 2 + 1] AS median, max(distinct_days) AS maximum, CAST(sum(distinct_days) AS BIGINT) AS total FROM s""",
)
def q_totals(spark, sf_dir):
    return temporal.survey_totals(temporal.place_survey(surveyed(spark, sf_dir), observations(spark, sf_dir)))


@register(
    "select_dates",
    with_sql(SQL_CHOSEN) + "SELECT place_id, string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day) AS days FROM chosen GROUP BY place_id",
)
def q_select(spark, sf_dir):
    chosen = temporal.select_dates(temporal.place_days(observations(spark, sf_dir)), MAX_DATES)
    return chosen.select("place_id", dates("days").alias("days"))


@register(
    "choose_queries",
    with_sql(SQL_DAYS) + """, o AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY day) - 1 AS p, count(*) OVER (PARTITION BY place_id) AS n FROM days),
s AS (SELECT DISTINCT place_id, least(CAST(floor((i + 0.5) * n / 5) AS BIGINT), n - 1) AS p FROM extent, range(0, 5) t(i) WHERE n > 5)
SELECT place_id, string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day) AS query_days, count(*) AS queries FROM o JOIN s USING (place_id, p) GROUP BY place_id""",
)
def q_choose(spark, sf_dir):
    chosen = temporal.choose_queries(temporal.place_days(observations(spark, sf_dir)), 5)
    return chosen.select("place_id", dates("query_days").alias("query_days"), F.size("query_days").cast("bigint").alias("queries"))


@register("day_gap", with_sql(SQL_CHOSEN) + "SELECT place_id, day AS acquisition_day, CAST(gap AS INTEGER) AS day_gap_to_nearest_index FROM gaps")
def q_gap(spark, sf_dir):
    days = temporal.select_dates(temporal.place_days(observations(spark, sf_dir)), MAX_DATES)
    return temporal.day_gap(temporal.choose_queries(days, QUERY_DATES))


def _guarded(spark, sf_dir):
    return temporal.guarded_split(observations(spark, sf_dir), ANCHOR, QUERY_COUNT, MIN_GAP)


@register("guarded_split", with_sql(SQL_GUARD) + "SELECT place_id, day AS acquisition_day, split FROM roles")
def q_guarded(spark, sf_dir):
    return _guarded(spark, sf_dir).select("place_id", "acquisition_day", "split")


@register(
    "resplit_report",
    with_sql(SQL_GUARD) + """SELECT place_id, count(*) AS available_days, count(*) FILTER (split = 'query') AS queries,
  count(*) FILTER (split = 'index') AS index_days, count(*) FILTER (split = 'excluded') AS excluded_days,
  CAST(coalesce((SELECT min(gap) FROM gaps g WHERE g.place_id = r.place_id), 0) AS INTEGER) AS observed_min_gap_days,
  count(*) FILTER (split = 'index') > 0 AS usable FROM roles r GROUP BY place_id""",
)
def q_report(spark, sf_dir):
    return temporal.resplit_report(_guarded(spark, sf_dir))


def corpus_records(spark, sf_dir):
    """Every acquisition as a corpus record, several per place and day."""
    return acquisitions(spark, sf_dir).filter(F.col("datetime").isNotNull()).select(
        "place_id", F.to_date("datetime").alias("acquisition_day"), "item_id", F.lit("index").alias("split"), "cloud"
    )


SQL_RESPLIT = SQL_GUARD + """,
latest AS (SELECT place_id, CAST(datetime AS DATE) AS day, max(item_id) AS item_id FROM acq WHERE datetime IS NOT NULL GROUP BY ALL),
corpus AS (SELECT l.place_id, l.day, l.item_id, r.split, g.gap FROM latest l JOIN roles r USING (place_id, day)
  LEFT JOIN gaps g ON g.place_id = l.place_id AND g.day = l.day AND r.split = 'query'
  WHERE r.split <> 'excluded' AND l.place_id IN (SELECT place_id FROM roles WHERE split = 'index'))"""


@register(
    "temporal_resplit",
    with_sql(SQL_RESPLIT) + "SELECT place_id, day AS acquisition_day, item_id, split, CAST(gap AS INTEGER) AS day_gap_to_nearest_index FROM corpus",
)
def q_resplit(spark, sf_dir):
    return temporal.resplit_corpus(corpus_records(spark, sf_dir), ANCHOR, QUERY_COUNT, MIN_GAP).select(
        "place_id", "acquisition_day", "item_id", "split", "day_gap_to_nearest_index"
    )


@register(
    "resplit_totals",
    with_sql(SQL_RESPLIT) + """SELECT count(*) AS images, count(*) FILTER (split = 'index') AS index_items, count(*) FILTER (split = 'query') AS query_items,
  CAST(min(gap) AS INTEGER) AS minimum, CAST(list_sort(list(gap) FILTER (split = 'query'))[count(*) FILTER (split = 'query') // 2 + 1] AS INTEGER) AS median,
  CAST(max(gap) AS INTEGER) AS maximum FROM corpus""",
)
def q_resplit_totals(spark, sf_dir):
    return temporal.resplit_totals(
        temporal.resplit_corpus(corpus_records(spark, sf_dir), ANCHOR, QUERY_COUNT, MIN_GAP)
    )


@register(
    "temporal_corpus",
    with_sql(SQL_CHOSEN) + """SELECT r.place_id || '/' || strftime(r.day, '%Y-%m-%d') AS item_id, o.item_id AS source_item_id, o.cloud, r.split,
  CAST(g.gap AS INTEGER) AS day_gap_to_nearest_index FROM roles r JOIN obs o ON o.place_id = r.place_id AND o.acquisition_day = strftime(r.day, '%Y-%m-%d')
LEFT JOIN gaps g ON g.place_id = r.place_id AND g.day = r.day""",
)
def q_corpus(spark, sf_dir):
    corpus, _ = temporal.temporal_corpus(observations(spark, sf_dir), MAX_DATES, QUERY_DATES)
    return corpus.select("item_id", "source_item_id", "cloud", "split", "day_gap_to_nearest_index")


@register(
    "temporal_failures",
    with_sql(SQL_ACQUISITIONS) + """, k AS (SELECT place_id, count(*) AS n FROM obs WHERE acquisition_day <> 'unknown' AND (key % 25 <> 3 OR place_id <> 'nation_3') AND
  (place_id NOT IN ('nation_1', 'nation_2') OR acquisition_day = (SELECT min(acquisition_day) FROM obs o WHERE o.place_id = obs.place_id)) GROUP BY place_id)
SELECT place_id, 'fewer than two dates' AS reason FROM k WHERE n < 2""",
)
def q_failures(spark, sf_dir):
    """Two places cut down to their first day cannot hold a query and an answer."""
    seen = observations(spark, sf_dir)
    first = seen.groupBy("place_id").agg(F.min("acquisition_day").alias("first"))
    cut = seen.join(first, "place_id").filter(
        ~F.col("place_id").isin("nation_1", "nation_2") | (F.col("acquisition_day") == F.col("first"))
    ).drop("first")
    return temporal.temporal_corpus(cut, MAX_DATES, QUERY_DATES)[1]


# ---- from a places file to days ---------------------------------------------


def places_file(spark, sf_dir) -> str:
    """The places as a configuration file, kept clear of the antimeridian."""
    path = scratch_path(spark, "places-file")
    listed = places(spark, sf_dir).select(
        "place_id", F.least(F.greatest("longitude", F.lit(-179.0)), F.lit(179.0)).alias("longitude"), "latitude",
        F.when(F.col("key") % 2 == 0, F.concat(F.lit("note "), F.col("key").cast("string"))).alias("note"),
    )
    # A configuration: one list, as long as there are places.
    listed.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return path


SQL_FILED = SQL_PLACES + """,
filed AS (SELECT place_id, least(greatest(longitude, -179.0), 179.0) AS longitude, latitude,
  CASE WHEN key % 2 = 0 THEN 'note ' || key ELSE '' END AS note FROM places)"""


@register("places_file", with_sql(SQL_FILED) + "SELECT place_id, longitude, latitude, note FROM filed")
def q_places_file(spark, sf_dir):
    return temporal.read_places(spark, places_file(spark, sf_dir))


@register(
    "place_pipeline",
    with_sql(SQL_FILED) + """, w AS (SELECT place_id, 20000.0 / 2 / 111320.0 AS half, longitude AS x, latitude AS y FROM filed),
i AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id, DATE '2024-01-01' + CAST(c_custkey % 40 AS INTEGER) AS day,
  CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey * 37 % 100 AS DOUBLE) END AS cloud,
  CAST((c_custkey * 7919 % 3600) / 10.0 - 180.0 AS DOUBLE) AS x, CAST((c_custkey * 4729 % 1400) / 10.0 - 70.0 AS DOUBLE) AS y FROM customer),
met AS (SELECT place_id, item_id, cloud, strftime(day, '%Y-%m-%d') AS day FROM w
  JOIN i ON w.x - half / cos(radians(w.y)) <= i.x + 4 AND w.x + half / cos(radians(w.y)) >= i.x - 4 AND w.y - half <= i.y + 3 AND w.y + half >= i.y - 3),
best AS (SELECT *, count(*) OVER (PARTITION BY place_id, day) AS n FROM met
  QUALIFY row_number() OVER (PARTITION BY place_id, day ORDER BY coalesce(cloud, 1e300), item_id) = 1)
SELECT f.place_id, note, CAST(coalesce(sum(n), 0) AS BIGINT) AS items_returned, count(day) AS distinct_days, count(day) >= 2 AS usable,
  coalesce(string_agg(day || ':' || item_id || ':' || coalesce(CAST(CAST(cloud AS BIGINT) AS VARCHAR), '-'), ';' ORDER BY day), '') AS observations
FROM filed f LEFT JOIN best USING (place_id) GROUP BY f.place_id, note""",
)
def q_place_pipeline(spark, sf_dir):
    """From a places file over windows and catalogue items to each place's list of days."""
    key = F.col("c_custkey")
    dated = read(spark, sf_dir, "customer").select(
        key.cast("string").alias("item_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 40).cast("int")).cast("timestamp").alias("datetime"),
        F.when(key % 17 != 0, (key * 37 % 100).cast("double")).alias("cloud"),
    )
    listed = temporal.read_places(spark, places_file(spark, sf_dir))
    observed = temporal.observe_places(listed, item_boxes(spark, sf_dir).join(dated, "item_id"), 20_000.0)
    told = F.transform("observations", lambda o: F.concat_ws(
        ":", o["acquisition_day"], o["item_id"], F.coalesce(o["cloud"].cast("bigint").cast("string"), F.lit("-"))))
    return temporal.survey_report(listed, observed).select(
        "place_id", "note", "items_returned", "distinct_days", "usable", F.array_join(told, ";").alias("observations")
    )


@register(
    "corpus_report",
    with_sql(SQL_CHOSEN) + """, q AS (SELECT place_id, string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day) AS queries FROM roles WHERE split = 'query' GROUP BY 1)
SELECT r.place_id, any_value(e.n) AS available_days, count(*) AS selected_days, count(*) AS written, any_value(q.queries) AS queries,
  min(r.day) AS first_day, max(r.day) AS last_day FROM roles r JOIN extent e USING (place_id) JOIN q USING (place_id) GROUP BY r.place_id""",
)
def q_corpus_report(spark, sf_dir):
    seen = observations(spark, sf_dir)
    corpus, _ = temporal.temporal_corpus(seen, MAX_DATES, QUERY_DATES)
    report = temporal.corpus_report(seen, MAX_DATES, corpus)
    days = F.transform("queries", lambda day: F.date_format(day, "yyyy-MM-dd"))
    return report.withColumn("queries", F.array_join(days, ","))
