"""Lake layout, landing, the batch jobs end to end, streaming, and plan properties."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from pitchlake import fixtures as fx
from pitchlake.operators import features as ft
from pitchlake.plans import clustering as cl
from pitchlake.plans import gold as gold_job
from pitchlake.plans import silver as silver_job
from pitchlake.sources import lake, landing


def test_paths():
    assert lake.bronze_day_path("s3a://b/bronze/", dt.date(2024, 4, 1)) == "s3a://b/bronze/year=2024/date=2024-04-01"
    assert lake.role_year_path("/lake/silver", "batter", 2024) == "/lake/silver/role=batter/year=2024"
    assert lake.leaderboard_path("/raw", "sprint_speed", 2023) == "/raw/sprint_speed/year=2023"


def test_effective_window():
    assert silver_job.effective_window(dt.date(2024, 5, 3), dt.date(2024, 5, 4), year_to_date=True) == (dt.date(2024, 1, 1), dt.date(2024, 5, 4))
    assert silver_job.effective_window(dt.date(2023, 12, 30), dt.date(2024, 1, 2), year_to_date=True)[0] == dt.date(2023, 1, 1)
    assert silver_job.effective_window(dt.date(2024, 5, 3), dt.date(2024, 5, 4), year_to_date=False)[0] == dt.date(2024, 5, 3)


@pytest.fixture(scope="module")
def lake_root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    pitches = fx.pitches(spark, SF0001).where(F.col("year") == 1996)
    res = landing.land_days(pitches, date_col="game_date", start_date="1996-01-01", end_date="1996-12-31",
                            bronze_root=str(root / "bronze"), today=dt.date(2030, 1, 1))
    assert res["status"] == "ok" and res["days_ok"] > 0 and res["days_error"] == 0
    assert res["days_ok"] + res["days_no_data"] == 366
    return root


def test_landing_statuses(spark, lake_root):
    pitches = fx.pitches(spark, SF0001).where(F.col("year") == 1996)
    res = landing.land_days(pitches, date_col="game_date", start_date="1996-12-30", end_date="1997-01-02",
                            bronze_root=str(lake_root / "bronze_b"), today=dt.date(1996, 12, 31))
    assert res["status"] == "partial" and res["days_error"] == 2 and "future" in res["errors"][0]
    assert landing.land_days(pitches, date_col="game_date", start_date="1996-13-01", end_date="1996-12-31",
                             bronze_root=str(lake_root / "x"))["status"] == "error"
    assert landing.land_days(pitches, date_col="game_date", start_date="1996-12-31", end_date="1996-12-01",
                             bronze_root=str(lake_root / "x"))["status"] == "error"


def test_bronze_read_prunes_partitions(spark, lake_root):
    df = lake.read_bronze_range(spark, str(lake_root / "bronze"), dt.date(1996, 3, 1), dt.date(1996, 3, 31))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [" in plan
    assert df.select("game_date").distinct().count() <= 31
    total = lake.read_partitioned(spark, str(lake_root / "bronze")).count()
    assert total == fx.pitches(spark, SF0001).where(F.col("year") == 1996).count()


def test_silver_plan_has_no_python_udf_and_one_dedupe_exchange(spark):
    df = ft.pitcher_features(fx.pitches(spark, SF0001), ft.FeatureParams(min_pitches_pitcher=10), with_pitch_types=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert plan.count("Exchange hashpartitioning(pitcher") == 2  # dedupe key, then partial aggregates
    assert "WindowGroupLimit" in plan  # copies of a pitch are collapsed map-side, before the shuffle


def test_hot_duplicate_group_collapses(spark):
    from pitchlake.operators.dedupe import dedupe_last

    src = fx.pitches(spark, SF0001)
    one = src.limit(1)
    copies = one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(20000)))).drop("_copy").repartition(16)
    df = src.unionByName(copies)
    out = dedupe_last(df, ("pitcher", "year"))
    assert out.count() == dedupe_last(src, ("pitcher", "year")).count()


def test_silver_gold_cluster_similarity_jobs(spark, lake_root):
    params = ft.FeatureParams(min_pitches_pitcher=20, min_pitches_batter=8, min_batted_ball_batter=2)
    fb = fx.field_board(spark, SF0001)
    res = silver_job.build_bronze_to_silver(
        spark, bronze_root=str(lake_root / "bronze"), silver_root=str(lake_root / "silver"),
        start_date="1996-06-01", end_date="1996-06-30", params=params,
        sprint_board=fx.sprint_board(spark, SF0001), register=fx.register(spark, SF0001),
        fielding_sources={"oaa": fb, "catch": fb, "arm": fb, "poptime": fb, "framing": fb, "fielding": fb})
    assert res["status"] == "ok" and res["years_written"] == [1996] and res["rows_written"] > 0
    assert res["bronze_start"] == "1996-01-01"
    silver = lake.read_partitioned(spark, str(lake_root / "silver"))
    roles = {r["role"] for r in silver.select("role").distinct().collect()}
    assert roles == {"batter", "pitcher"}

    g = gold_job.build_silver_to_gold(spark, silver_root=str(lake_root / "silver"), gold_root=str(lake_root / "gold"),
                                      metadata_root=str(lake_root / "gold_meta"), start_year=1996, end_year=1996)
    assert g["status"] == "ok" and len(g["role_years_processed"]) == 2
    meta = [json.loads(r["payload"]) for r in lake.read_metadata(spark, str(lake_root / "gold_meta")).collect()]
    assert {m["role"] for m in meta} == {"batter", "pitcher"} and all("generated_at_utc" in m for m in meta)

    c = cl.build_clustering(spark, gold_root=str(lake_root / "gold"), out_root=str(lake_root / "clusters"), years=[1996],
                            specs={"pitcher": cl.ClusterSpec(3, 3, n_init=1), "batter": cl.ClusterSpec(2, 2, n_init=1)})
    assert c["status"] == "ok", c
    s = cl.build_similarity(spark, gold_root=str(lake_root / "gold"), model_root=str(lake_root / "clusters" / "models"),
                            out_root=str(lake_root / "similar"), years=[1996], k_neighbors=5)
    assert s["status"] == "ok", s
    nb = lake.read_partitioned(spark, str(lake_root / "similar" / "neighbors"))
    n_batters = lake.read_partitioned(spark, str(lake_root / "gold")).where("role = 'batter'").count()
    assert nb.where("role = 'batter'").count() == n_batters * min(5, n_batters - 1)
    missing = cl.build_similarity(spark, gold_root=str(lake_root / "gold"), model_root=str(lake_root / "nope"),
                                  out_root=str(lake_root / "similar2"), years=[1996])
    assert missing["status"] == "error" and len(missing["errors"]) == 2


def test_silver_job_no_data_and_bad_dates(spark, lake_root):
    r = silver_job.build_bronze_to_silver(spark, bronze_root=str(lake_root / "bronze"), silver_root=str(lake_root / "s2"),
                                          start_date="2020-01-01", end_date="2020-01-02")
    assert r["status"] == "no_data"
    r = silver_job.build_bronze_to_silver(spark, bronze_root=str(lake_root / "bronze"), silver_root=str(lake_root / "s2"),
                                          start_date="2020-01-05", end_date="2020-01-02")
    assert r["status"] == "error"


def test_rate_violation_detection(spark):
    df = spark.createDataFrame([(1, 2024, 0.5, 1.2), (2, 2024, -0.1, 0.3)], "player_id long, year int, swing_rate double, chase_rate double")
    bad = {(r["player_id"], r["column"]) for r in silver_job.rate_violations(df, "batter").collect()}
    assert bad == {(1, "chase_rate"), (2, "swing_rate")}


def test_csv_leaderboard_and_position_union(spark, tmp_path):
    p = tmp_path / "board.csv"
    p.write_text("﻿Player ID,Outs Above Average\n1,3\n2,-1\n", encoding="utf-8")
    df = landing.read_leaderboard_csv(spark, str(p))
    assert df.columns == ["player_id", "outs_above_average"] and df.count() == 2
    u = landing.union_position_boards({3: df, 4: df.drop("outs_above_average")})
    assert u.count() == 4 and u.where("position = 4 AND outs_above_average IS NULL").count() == 2


def test_bronze_stream_available_now(spark, tmp_path):
    from pitchlake.streaming.bronze_stream import land_stream, pitch_stream

    src = fx.pitches(spark, SF0001).where(F.col("year") == 1997).limit(200)
    land = tmp_path / "landing"
    src.write.parquet(str(land / "batch1"))
    src.limit(50).write.parquet(str(land / "batch2"))  # re-delivered duplicates
    stream = pitch_stream(spark, str(land) + "/*", src.schema)
    q = land_stream(stream, bronze_root=str(tmp_path / "bronze"), checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = lake.read_partitioned(spark, str(tmp_path / "bronze"))
    # bronze holds whole days: a key that stands on two days is two rows, and silver picks the last (A1)
    assert out.count() == src.select("game_pk", "at_bat_number", "pitch_number", "game_date").distinct().count()


def test_bronze_stream_keeps_days_whole_over_batches_and_runs(spark, tmp_path):
    """One day in two batches, a later run, a correction, a very late day and a retried batch: as if all had come at once."""
    from pitchlake.streaming import bronze_stream as bs

    schema = "game_pk long, at_bat_number int, pitch_number int, game_date date, note string"
    day, late = dt.date(2024, 5, 1), dt.date(1999, 5, 1)
    parts = [
        [(1, 1, i, day, "a") for i in range(40)],
        [(1, 1, i, day, "b") for i in range(30, 60)],  # corrects ten, adds twenty
        [(2, 1, 1, late, "c")],
        [(1, 1, 5, day, "d"), (None, None, None, None, "no day")],
    ]
    land, bronze = tmp_path / "landing", str(tmp_path / "bronze")

    def run(checkpoint):
        stream = bs.pitch_stream(spark, f"{land}/*", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
        bs.land_stream(stream, bronze_root=bronze, checkpoint_location=str(tmp_path / checkpoint)).awaitTermination(120)

    def rows():
        return {(r.game_pk, r.pitch_number): (r.game_date, r.note) for r in lake.read_partitioned(spark, bronze).collect()}

    want = {}
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(land / f"f{n}"))
        want.update({(p[0], p[2]): (p[3], p[4]) for p in part if p[3]})
        if n:
            run("ckpt")
            assert rows() == want
    assert lake.read_partitioned(spark, bronze).count() == len(want) == 61
    run("other")  # everything once more, as after a lost checkpoint
    assert rows() == want


def test_serving_tables_from_job_outputs(spark, lake_root):
    from pitchlake.operators import mixture as mx
    from pitchlake.plans import serving as sv

    a, n = lake.load_serving_tables(spark, archetypes_root=str(lake_root / "clusters" / "assignments"),
                                    neighbors_root=str(lake_root / "similar" / "neighbors"), year=1996)
    assert {r["role"] for r in a.select("role").distinct().collect()} == {"batter", "pitcher"}
    payload = sv.clusters_payload(a).collect()
    assert sum(r["n_players"] for r in payload) == a.count()
    pid = n.first()["player_id"]
    role = n.where(F.col("player_id") == pid).first()["role"]
    assert sv.neighbors_for_player(n, player_id=pid, role=role.upper()).count() >= 1
    assert sv.player_name_lookup(a, player_id=-1, role="batter") is None
    gmm = mx.load_mixtures(spark, str(lake_root / "clusters" / "models" / "role=batter" / "year=1996" / "gmm"))
    assert gmm[()].k == 2


def test_streaming_windowed_counts(spark, tmp_path):
    from pitchlake.streaming.bronze_stream import windowed_counts

    ev = fx.table(spark, SF0001, "events")
    src = tmp_path / "events"
    ev.write.parquet(str(src))
    stream = spark.readStream.schema(ev.schema).parquet(str(src))
    q = (windowed_counts(stream, ts_col="ts", window="1 day", watermark="1 day", keys=("event_type",))
         .writeStream.outputMode("complete").format("memory").queryName("wc_test").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("SELECT SUM(n_rows) AS n FROM wc_test").first()["n"]
    assert got == ev.count()


def test_pitcher_features_with_profile_scan_pitches_once(spark):
    df = ft.pitcher_features(fx.pitches(spark, SF0001), ft.FeatureParams(min_pitches_pitcher=10))
    plan = df._jdf.queryExecution().executedPlan().toString()  # before execution: initial plan only
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 2


def test_last_copy_in_load_order_wins(spark, tmp_path):
    """Conflicting copies of a pitch over files and rows of one day; days with different columns."""
    cols = "game_pk long, at_bat_number int, pitch_number int, pitcher long, game_date date, year int, date string, note string"
    d1, d2 = dt.date(2024, 4, 1), dt.date(2024, 4, 2)
    first = [(1, 1, i, 7, d1, 2024, "2024-04-01", f"row{k}") for k in range(4) for i in range(50)]
    root = str(tmp_path / "bronze")
    day1 = f"{root}/year=2024/date=2024-04-01"
    spark.createDataFrame(first, cols).drop("year", "date").coalesce(1).write.parquet(day1)
    more = spark.createDataFrame([(1, 1, 0, 7, d2, "next day", 71.5)], "game_pk long, at_bat_number int, pitch_number int, pitcher long, game_date date, note string, bat_speed double")
    more.coalesce(1).write.parquet(f"{root}/year=2024/date=2024-04-02")
    from pitchlake.operators.dedupe import dedupe_last

    bronze = lake.read_bronze_range(spark, root, d1, d2)
    assert "bat_speed" in bronze.columns
    got = {r.pitch_number: r.note for r in dedupe_last(bronze.repartition(8), ("pitcher", "year"), order_cols=(lake.FILE_ORDER,)).collect()}
    assert got == {0: "next day", **{i: "row3" for i in range(1, 50)}}


def test_window_and_limits_are_checked(spark, tmp_path):
    from pitchlake.plans import serving as sv

    with pytest.raises(ValueError):
        lake.date_window("2024-02-02", "2024-02-01")
    assert gold_job.build_silver_to_gold(spark, silver_root="x", gold_root="y", metadata_root="z", start_year=2024, end_year=2023)["status"] == "error"
    with pytest.raises(ValueError):
        sv.player_leaderboard(spark.createDataFrame([(1, "a", 0, "batter")], "player_id long, player_name string, cluster_id int, role string"), "batter", 0)


def test_features_without_optional_zone_columns(spark):
    src = fx.pitches(spark, SF0001)
    params = ft.FeatureParams(min_pitches_pitcher=10, min_pitches_batter=10, min_batted_ball_batter=1)
    whole = ft.batter_features(src, params)
    assert ft.batter_features(src.drop("plate_z", "sz_bot", "sz_top"), params).count() == whole.count()
    assert ft.pitcher_features(src.drop("sz_bot", "sz_top"), params, with_pitch_types=False).count() > 0


def test_ids_are_exact(spark):
    from pitchlake.functions.clean import to_long_id

    df = spark.createDataFrame([(9007199254740993, "9007199254740993", "12.0", 3.0, "x")], "a long, b string, c string, d double, e string")
    r = df.select(*[to_long_id(c).alias(c) for c in df.columns]).first()
    assert tuple(r) == (9007199254740993, 9007199254740993, 12, 3, None)


def test_quarantine_and_delivery_order(spark, tmp_path):
    """Invalid rows are set aside with reason and source, the rest of their day lands; of two deliveries the later counts."""
    import datetime as dt
    import time

    from pitchlake.operators.dedupe import dedupe_last

    files, bronze, aside = (str(tmp_path / n) for n in ("files", "bronze", "aside"))
    columns = "game_pk long, at_bat_number int, pitch_number int, pitcher long, day string, speed double"
    first = [(1, 1, n, 7, "2024-04-01", 90.0) for n in range(200)] + [(2, 1, 1, None, "2024-04-01", 1.0), (3, 1, 1, None, "2024-04-02", None)]
    first += [(4, 1, 1, 7, None, 5.0), (5, 1, 1, 7, "2024-04-09", 5.0), (6, 1, 1, 7, "2030-01-01", 5.0)]
    spark.createDataFrame(first, columns).coalesce(1).write.parquet(f"{files}/z-first")
    time.sleep(1.1)  # file times may have whole seconds
    spark.createDataFrame([(1, 1, n, 7, "2024-04-01", 95.0) for n in range(0, 200, 2)], columns).coalesce(1).write.parquet(f"{files}/a-second")
    landed = lake.with_delivery(spark.read.parquet(f"{files}/z-first", f"{files}/a-second"))

    def land(**more):
        return landing.land_days(landed, date_col="day", start_date="2024-04-01", end_date="2024-04-03", bronze_root=bronze,
                                 today=dt.date(2024, 5, 1), required=("pitcher", "speed"), **more)

    refused = land()
    assert refused["status"] == "partial" and refused["days_error"] == 2 and "rows_landed" not in refused
    done = land(quarantine_root=aside)
    assert (done["days_ok"], done["days_error"], done["days_no_data"]) == (1, 1, 1)
    assert (done["rows_landed"], done["rows_quarantined"]) == (300, 3)
    held = {(r["game_pk"], r["year"], str(r["date"]), tuple(r["_reason"]), r["_delivered"]["path"].split("/")[-2]) for r in lake.read_partitioned(spark, aside).collect()}
    assert held == {(2, 2024, "2024-04-01", ("pitcher",), "z-first"), (3, 2024, "2024-04-02", ("pitcher", "speed"), "z-first"), (4, 0, "none", ("day",), "z-first")}
    read = lake.read_bronze_range(spark, bronze, dt.date(2024, 4, 1), dt.date(2024, 4, 3))
    assert "_reason" not in read.columns and read.count() == 300
    kept = {r["pitch_number"]: r["speed"] for r in dedupe_last(read, ("pitcher", "year"), order_cols=(lake.FILE_ORDER,)).collect()}
    assert kept == {n: 90.0 if n % 2 else 95.0 for n in range(200)}


def test_writes_report_what_they_wrote(spark, tmp_path):
    """Observed aggregates are those of the rows written, whatever the partitions; an empty write reports none."""
    df = spark.range(1000).selectExpr("id", "'pitcher' AS role", "cast(2020 + id % 3 AS int) AS year").repartition(7)
    seen = {"rows": F.count(F.lit(1)), "years": F.collect_set("year")}
    done = lake.write_partitioned(df, str(tmp_path / "t"), ("role", "year"), observe=seen)
    assert done["rows"] == 1000 and sorted(done["years"]) == [2020, 2021, 2022]
    assert lake.read_partitioned(spark, str(tmp_path / "t")).count() == 1000
    none = lake.write_partitioned(df.limit(0), str(tmp_path / "u"), ("role", "year"), observe=seen)
    assert none["rows"] == 0 and none["years"] == []
    assert lake.write_partitioned(df, str(tmp_path / "t"), ("role", "year")) == {}


def test_short_order_is_the_same_order_in_numbers(spark, tmp_path):
    """Names of files become ranks; rows from before deliveries were kept come first, and the last copy stays the last."""
    from pitchlake.operators.dedupe import dedupe_last

    files, root = str(tmp_path / "files"), str(tmp_path / "bronze")
    rows = [(g, 1, 1, 7, dt.date(1996, 6, 1 + g % 3), float(g)) for g in range(40)]
    src = spark.createDataFrame(rows, "game_pk long, at_bat_number int, pitch_number int, pitcher long, day date, speed double")
    for k in (10, 9):  # by name the first comes first, by time the second does not
        src.where(f"game_pk % 4 <> {k % 2}").withColumn("speed", F.col("speed") + k).repartition(3).write.parquet(f"{files}/delivery={k}")
    landed = lake.with_delivery(spark.read.option("basePath", files).parquet(files)).drop("delivery")
    landing.land_days(landed, date_col="day", start_date="1996-06-01", end_date="1996-06-03", bronze_root=root)
    early = src.where("game_pk % 5 = 0").withColumns({"speed": F.lit(-1.0), "year": F.lit(1996), "date": F.col("day").cast("string")})
    early.write.mode("append").partitionBy("year", "date").parquet(root)  # no delivery
    read = lake.read_bronze_range(spark, root, dt.date(1996, 6, 1), dt.date(1996, 6, 3))
    short = lake.with_short_order(read)
    assert short.columns == read.columns and "string" not in short.schema[lake.FILE_ORDER].dataType.simpleString()
    ordered = [[tuple(r) for r in df.orderBy(lake.FILE_ORDER).select("game_pk", "speed", "date").collect()] for df in (read, short)]
    assert len(ordered[0]) == 68 and ordered[0] == ordered[1]
    last = [sorted(tuple(r) for r in dedupe_last(df, ("pitcher", "year"), order_cols=(lake.FILE_ORDER,), ties=ties).select("game_pk", "speed").collect()) for df, ties in ((read, True), (short, False))]
    assert len(last[0]) == 40 and last[0] == last[1]
    plain = lake.with_file_order(spark.read.parquet(files))  # without deliveries
    ordered = [[tuple(r) for r in df.orderBy(lake.FILE_ORDER).select("game_pk", "speed").collect()] for df in (plain, lake.with_short_order(plain))]
    assert len(ordered[0]) == 60 and ordered[0] == ordered[1]


def test_many_rows_land_in_runs_of_days(spark, tmp_path, monkeypatch):
    """Each run is a write with a shuffle of its own; days, rows and counts are those of one write."""
    rows = [(d, i, None if i % 7 == 0 else 1.0) for d in range(1, 29) for i in range(10)] + [(3, i, 2.0) for i in range(200)]
    rows = spark.createDataFrame(rows, "d int, i int, speed double").withColumn("day", F.date_add(F.lit(dt.date(1996, 5, 31)), F.col("d")))
    rows = rows.unionByName(rows.limit(1).withColumns({"day": F.lit(None).cast("date"), "speed": F.lit(None).cast("double")})).checkpoint()
    writes, keep = [], lake.write_partitioned

    def recorded(df, root, *given, **more):
        writes.append(root)
        conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(conf)
        keep(df, root, *given, **more)
        assert spark.conf.get(conf) == before

    def land(name):
        root, aside = str(tmp_path / name), str(tmp_path / f"{name}-aside")
        status = landing.land_days(rows, date_col="day", start_date="1996-06-01", end_date="1996-06-30", bronze_root=root, required=("speed",), quarantine_root=aside)
        found = [sorted(map(str, lake.read_partitioned(spark, r).select("year", "date", "i", "speed").collect())) for r in (root, aside)]
        return status, found, writes.count(root)

    monkeypatch.setattr(lake, "write_partitioned", recorded)
    one = land("one")
    monkeypatch.setattr(landing, "AT_ONCE", 10, raising=False)
    many = land("many")
    assert one[0]["rows_landed"] == 424 and one[0]["rows_quarantined"] == 57 and one[2] == 1
    assert many[:2] == one[:2] and 3 <= many[2] <= landing.RUNS + 2
    assert landing._runs([(2, 5), (1, 5), (3, 20), (4, 1)], 10) == [(1, 2), (3, 3), (4, 4)]
