import datetime as dt

import pytest
from pyspark.sql import functions as F

from orbitrank.operators import temporal

ITEMS = "place_id string, item_id string, datetime timestamp, cloud double"


def obs(spark, days, place="p"):
    rows = [(place, str(d)) for d in days]
    return spark.createDataFrame(rows, "place_id string, acquisition_day string")


def at(text):
    return dt.datetime.fromisoformat(text)


def test_least_cloudy_and_missing_cloud(spark):
    items = spark.createDataFrame(
        [("p", "b", at("2024-06-01T10:00"), 8.0), ("p", "a", at("2024-06-01T10:05"), 2.0),
         ("p", "c", at("2024-06-02T10:00"), None), ("p", "d", at("2024-06-02T11:00"), 5.0),
         ("p", "e", None, 1.0), ("p", "g", at("2024-06-03T10:00"), 4.0), ("p", "f", at("2024-06-03T10:00"), 4.0)], ITEMS)
    found = temporal.day_dedupe(items)
    assert {(r["acquisition_day"], r["item_id"]) for r in found.collect()} == {
        ("2024-06-01", "a"), ("2024-06-02", "d"), ("unknown", "e"), ("2024-06-03", "f")}
    places = spark.createDataFrame([("p",), ("empty",)], "place_id string")
    rows = {r["place_id"]: r for r in temporal.place_survey(places, found).collect()}
    row, none = rows["p"], rows["empty"]
    assert (row["items_returned"], row["distinct_days"], row["usable"]) == (7, 4, True)
    assert (none["items_returned"], none["distinct_days"], none["usable"], none["first_day"]) == (0, 0, False, None)
    totals = temporal.survey_totals(temporal.place_survey(places, found)).first()
    assert (totals["places"], totals["minimum"], totals["median"], totals["total"]) == (2, 0, 4, 4)


def test_windows_stay_on_the_globe(spark):
    places = spark.createDataFrame([("ok", 10.0, 50.0), ("edge", 179.99, 0.0), ("pole", 0.0, 89.95)], "place_id string, longitude double, latitude double")
    found = temporal.window_violations(temporal.with_windows(places, 20_000.0)).collect()
    assert {(r["rule"], r["key"]) for r in found} == {("window_longitude_order", "edge"), ("window_latitude_order", "pole")}


def test_dates_spread_over_the_year(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=10 * i) for i in range(36)]
    chosen = temporal.select_dates(temporal.place_days(obs(spark, days)), 4).first()["days"]
    back = [dt.date(1970, 1, 1) + dt.timedelta(days=d) for d in chosen]
    assert back[0] == days[0] and back[-1] == days[-1] and len({d.month for d in back}) == 4
    few = temporal.select_dates(temporal.place_days(obs(spark, days[:3])), 4).first()["days"]
    assert len(few) == 3
    one = temporal.select_dates(temporal.place_days(obs(spark, days)), 1).first()["days"]
    assert [dt.date(1970, 1, 1) + dt.timedelta(days=d) for d in one] == [days[0]]
    with pytest.raises(ValueError):
        temporal.select_dates(temporal.place_days(obs(spark, days)), 0)


def test_equal_gaps_take_the_earlier_day(spark):
    days = ["2024-01-01", "2024-01-04", "2024-01-06", "2024-01-09"]
    chosen = temporal.select_dates(temporal.place_days(obs(spark, days)), 3).first()["days"]
    assert [str(dt.date(1970, 1, 1) + dt.timedelta(days=d)) for d in chosen] == [days[0], days[1], days[3]]


def test_queries_are_held_out_inside_the_timeline(spark):
    days = [dt.date(2024, m, 1) for m in range(1, 11)]
    row = temporal.choose_queries(temporal.place_days(obs(spark, days)), 2).first()
    back = [dt.date(1970, 1, 1) + dt.timedelta(days=d) for d in row["query_days"]]
    assert back == [days[2], days[7]]
    assert temporal.choose_queries(temporal.place_days(obs(spark, days[:2])), 2).count() == 0


def test_day_gap(spark):
    def days(query, index):
        number = lambda t: (dt.date.fromisoformat(t) - dt.date(1970, 1, 1)).days
        return spark.createDataFrame([("p", [number(query)], [number(d) for d in index])],
                                     "place_id string, query_days array<int>, index_days array<int>")

    assert temporal.day_gap(days("2024-06-15", ["2024-06-12", "2024-01-01"])).first()["day_gap_to_nearest_index"] == 3
    assert temporal.day_gap(days("2024-06-15", ["2024-12-15"])).first()["day_gap_to_nearest_index"] == 183


def test_guarded_split_of_a_monthly_place(spark):
    days = [dt.date(2024, m, 15) for m in range(1, 13)]
    rows = temporal.guarded_split(obs(spark, days), "2024-07-15", 2, 90).collect()
    assert sorted(r["acquisition_day"] for r in rows) == days
    queries = [r["acquisition_day"] for r in rows if r["split"] == "query"]
    assert sorted(queries) == [dt.date(2024, 6, 15), dt.date(2024, 7, 15)]
    for row in rows:
        if row["split"] == "index":
            assert min(abs((row["acquisition_day"] - q).days) for q in queries) >= 90
    three = temporal.guarded_split(obs(spark, days), "2024-07-15", 3, 60).filter("split = 'query'").collect()
    assert sorted(r["acquisition_day"].month for r in three) == [6, 7, 8]


def test_guard_boundary_clusters_and_single_days(spark):
    near = temporal.guarded_split(obs(spark, ["2024-01-01", "2024-01-11", "2024-01-21"]), "2024-01-01", 1, 10)
    assert {(str(r["acquisition_day"]), r["split"]) for r in near.collect()} == {
        ("2024-01-01", "query"), ("2024-01-11", "index"), ("2024-01-21", "index")}
    clustered = temporal.guarded_split(obs(spark, ["2024-07-01", "2024-07-05", "2024-07-09"]), "2024-07-01", 1, 90)
    report = temporal.resplit_report(clustered).first()
    assert (report["usable"], report["excluded_days"], report["observed_min_gap_days"]) == (False, 2, 0)
    alone = temporal.resplit_report(temporal.guarded_split(obs(spark, ["2024-07-01"]), "2024-07-01", 1, 5)).first()
    assert (alone["usable"], alone["queries"], alone["excluded_days"]) == (False, 0, 1)


def test_resplit_keeps_the_last_record_and_drops_places(spark):
    rows = [("p", dt.date(2024, 1, 1), "r1", "index"), ("p", dt.date(2024, 1, 1), "r2", "index"),
            ("p", dt.date(2024, 8, 1), "r3", "query"), ("z", dt.date(2024, 1, 1), "r4", "index")]
    records = spark.createDataFrame(rows, "place_id string, acquisition_day date, item_id string, split string")
    kept = {(r["item_id"], r["split"], r["day_gap_to_nearest_index"]) for r in temporal.resplit_corpus(records, "2024-08-01", 1, 90).collect()}
    assert kept == {("r2", "index", None), ("r3", "query", 213)}


def test_upper_median(spark):
    survey = spark.createDataFrame([("a", 2, True), ("b", 4, True), ("c", 9, True), ("d", 1, False)], "place_id string, distinct_days bigint, usable boolean")
    row = temporal.survey_totals(survey).first()
    assert (row["places"], row["usable_places"], row["median"], row["total"]) == (4, 3, 4, 16)


def test_place_rules(spark):
    places = spark.createDataFrame(
        [("ok", 1.0, 2.0), ("ok", 1.0, 2.0), ("a/b", 0.0, 0.0), ("", 0.0, 0.0), ("far", 200.0, 0.0), ("high", 0.0, 86.0)],
        "place_id string, longitude double, latitude double")
    assert {(r["rule"], r["key"]) for r in temporal.place_violations(places).collect()} == {
        ("duplicate_place_id", "ok"), ("unsafe_place_id", "a/b"), ("unsafe_place_id", ""),
        ("longitude_out_of_range", "far"), ("latitude_out_of_range", "high")}
    assert [r["rule"] for r in temporal.place_violations(places.limit(0)).collect()] == ["no_places"]


def test_guard_needs_no_lists_and_matches_all_gaps(spark):
    import random

    draw = random.Random(3)
    start = dt.date(2024, 1, 1)
    rows = {(f"p{i}", start + dt.timedelta(days=draw.randrange(900))) for i in range(6) for _ in range(draw.choice([1, 2, 9, 60]))}
    frame = spark.createDataFrame([(p, str(d)) for p, d in rows], "place_id string, acquisition_day string")
    found = temporal.guarded_split(frame, "2025-01-01", 3, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    got = {(r["place_id"], r["acquisition_day"]): r for r in found.collect()}
    assert set(got) == rows
    for place in {p for p, _ in rows}:
        days = {d: got[place, d] for p, d in rows if p == place}
        queries = [d for d, r in days.items() if r["split"] == "query"]
        index = [d for d, r in days.items() if r["split"] == "index"]
        for day, r in days.items():
            others = index if r["split"] == "query" else queries
            assert r["gap_days"] == min((abs((day - x).days) for x in others), default=None)
            assert r["usable"] == bool(index)
            assert (r["split"] == "index") == (bool(queries) and day not in queries and r["gap_days"] >= 20)


def test_boxes_of_all_sizes_meet_once(spark):
    import random

    draw = random.Random(9)

    def boxes(n, prefix):
        made = []
        for i in range(n):
            w, h = (draw.choice([0.0, 1e-5, 0.01, 0.25, 1.0, 7.3, 64.0, 300.0]) * draw.choice([1, draw.random()]) for _ in "wh")
            h = min(h, 170.0)
            x, y = draw.uniform(-180, 180 - min(w, 300)), draw.uniform(-85, 85 - h)
            if i % 5 == 0:
                x, y = round(x), round(y)  # on the borders of tiles
            made.append((f"{prefix}{i}", float(x), float(y), float(x + w), float(y + h)))
        return made + [(f"{prefix}hot{i}", 10.0, 50.0, 10.01, 50.01) for i in range(20)]

    left, right = boxes(150, "w"), boxes(200, "i")
    windows = spark.createDataFrame(left, "place_id string, west double, south double, east double, north double")
    items = spark.createDataFrame(right, "item_id string, west double, south double, east double, north double")
    got = [(r["place_id"], r["item_id"]) for r in temporal.items_in_windows(windows, items).collect()]
    expected = {
        (a[0], b[0]) for a in left for b in right if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]
    }
    assert len(got) == len(set(got)) and set(got) == expected
    tiles = temporal._tiles(temporal._levels(windows, ""), "", range(21)).groupBy("place_id", "level").count()
    assert tiles.agg({"count": "max"}).first()[0] <= 4
    none = items.limit(0)
    assert temporal.items_in_windows(windows, none).count() == temporal.items_in_windows(windows.limit(0), items).count() == 0


def test_places_files_are_read_or_refused(spark, tmp_path):
    import json

    def read(name, value):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
        return temporal.read_places(spark, str(tmp_path / name))

    good = {"place_id": "a", "longitude": 1.5, "latitude": 2}
    rows = read("good.json", [good, {**good, "place_id": "b", "note": "n", "more": 1}]).orderBy("place_id").collect()
    assert [tuple(r) for r in rows] == [("a", 1.5, 2.0, ""), ("b", 1.5, 2.0, "n")]
    for name, value, message in (
        ("none.json", [], "no_places"), ("twice.json", [good, good], "duplicate_place_id: a"),
        ("far.json", [{**good, "latitude": 86}], "latitude_out_of_range: a"),
        ("bare.json", [{"place_id": "a"}], "out_of_range: a"), ("path.json", [{**good, "place_id": "../a"}], "unsafe_place_id"),
    ):
        with pytest.raises(ValueError, match=message):
            read(name, value)


def test_survey_lists_days_in_order(spark):
    places = spark.createDataFrame([("p", 1.0, 2.0, "n"), ("empty", 3.0, 4.0, "")], "place_id string, longitude double, latitude double, note string")
    at = lambda day, hour=0: dt.datetime(2024, 6, day, hour)
    box = (0.9, 1.9, 1.1, 2.1)
    items = spark.createDataFrame(
        [("b", at(2), 5.0, *box), ("a", at(2, 9), 1.0, *box), ("c", at(1), None, *box), ("d", None, 0.0, *box), ("far", at(3), 0.0, 9.0, 9.0, 9.5, 9.5)],
        "item_id string, datetime timestamp, cloud double, west double, south double, east double, north double",
    )
    report = temporal.survey_report(places, temporal.observe_places(places, items, 1_000.0))
    rows = {r["place_id"]: r for r in report.collect()}
    assert [(o["acquisition_day"], o["item_id"]) for o in rows["p"]["observations"]] == [("2024-06-01", "c"), ("2024-06-02", "a"), ("unknown", "d")]
    assert (rows["p"]["items_returned"], rows["p"]["usable"], rows["p"]["note"]) == (4, True, "n")
    assert rows["empty"]["observations"] == [] and not rows["empty"]["usable"]
    off = places.withColumn("longitude", F.lit(180.0))
    with pytest.raises(ValueError, match="window_longitude_order"):
        temporal.observe_places(off, items, 1_000.0)
