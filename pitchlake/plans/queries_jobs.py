"""Registered queries over what jobs read: written lake folders with conflicting copies and drifting columns."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import enrich as en
from ..operators import features as ft
from ..operators import season_state as ss
from ..operators.dedupe import dedupe_last
from ..session import ensure_checkpoint_dir, short_lived_shuffles
from ..sources import lake, landing
from .queries_silver import _BATTER_SELECT, _PITCHER_SELECT, HAS_LAUNCH, PARAMS
from .registry import dedup_cte, finalize, flags_cte, register

P = fx.oracle_ctes("pitches")


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _days(df):
    return df.withColumn("date", F.col("game_date").cast("string"))


def _whole_range(spark, root, df):
    lo, hi = df.agg(F.min("game_date"), F.max("game_date")).first()
    return lake.read_bronze_range(spark, root, lo, hi)


# A1 on written days: every pitch stands twice in its day's file, the stale copy first
register(
    "bronze_keep_last",
    f"""{P}, c AS (SELECT pitcher, year, game_pk, pitch_number, at_bat_number, game_date, row_tiebreak, v.copy, release_speed + v.copy AS speed
      FROM pitches, (VALUES (0), (1)) v(copy) WHERE pitcher IS NOT NULL)
SELECT pitcher, year, game_pk, pitch_number, at_bat_number, game_date, row_tiebreak, copy, ROUND(speed, 10) AS speed
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pitcher, year, game_pk, pitch_number, at_bat_number
        ORDER BY game_date DESC, copy DESC, row_tiebreak DESC) AS rn FROM c) q WHERE rn = 1""",
)(lambda spark, d: bronze_keep_last(spark, d))


def bronze_keep_last(spark, d):
    src = fx.pitches(spark, d).where(F.col("pitcher").isNotNull())
    twice = src.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("speed", F.col("release_speed") + F.col("copy"))
    root = _folder(spark, "bronze")
    ordered = _days(twice).repartition("date").sortWithinPartitions("date", "copy", "row_tiebreak")
    ordered.write.partitionBy("year", "date").parquet(root)
    last = dedupe_last(_whole_range(spark, root, src), ("pitcher", "year"), order_cols=(lake.FILE_ORDER,))
    names = ("pitcher", "year", "game_pk", "pitch_number", "at_bat_number", "game_date", "row_tiebreak", "copy", "speed")
    return finalize(last.select(*names))


# J2 on a written register: later rows rename a third of the ids
register(
    "register_last_wins",
    f"""{fx.oracle_ctes('register')}, c AS (SELECT key_mlbam, name_last, name_first, file_order FROM register
  UNION ALL SELECT key_mlbam, CONCAT('New ', CAST(key_mlbam AS VARCHAR)), NULL, file_order + 1000000000 FROM register WHERE key_mlbam % 3 = 0),
n AS (SELECT key_mlbam AS player_id, file_order,
  NULLIF(CONCAT_WS(', ', NULLIF(TRIM(name_last), ''), NULLIF(TRIM(name_first), '')), '') AS player_name FROM c)
SELECT player_id, arg_max(player_name, file_order) AS player_name FROM n
WHERE player_id IS NOT NULL AND player_name IS NOT NULL GROUP BY player_id""",
)(lambda spark, d: register_last_wins(spark, d))


def register_last_wins(spark, d):
    first = fx.register(spark, d).select("key_mlbam", "name_last", "name_first", "file_order")
    renamed = first.where("key_mlbam % 3 = 0").select(
        "key_mlbam", F.concat(F.lit("New "), F.col("key_mlbam").cast("string")).alias("name_last"),
        F.lit(None).cast("string").alias("name_first"), (F.col("file_order") + 1_000_000_000).alias("file_order"))
    root = _folder(spark, "register")
    first.union(renamed).repartitionByRange("file_order").sortWithinPartitions("file_order").drop("file_order").write.parquet(root)
    return en.name_map(lake.with_file_order(spark.read.parquet(root)))


# Every other day lacks a column
register(
    "bronze_union_drift",
    f"""{P} SELECT game_date, COUNT(*) AS n_rows, COUNT(CASE WHEN EXTRACT(DAY FROM game_date) % 2 = 0 THEN delta_run_exp END) AS n_run_exp,
  ROUND(AVG(release_speed), 10) AS mean_speed FROM pitches GROUP BY game_date""",
)(lambda spark, d: bronze_union_drift(spark, d))


def bronze_union_drift(spark, d):
    src = fx.pitches(spark, d)
    root, even = _folder(spark, "drift"), F.dayofmonth("game_date") % 2 == 0
    for part in (_days(src.where(even)), _days(src.where(~even)).drop("delta_run_exp")):
        part.repartition("date").write.mode("append").partitionBy("year", "date").parquet(root)
    return finalize(_whole_range(spark, root, src).groupBy("game_date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("delta_run_exp").alias("n_run_exp"), F.avg("release_speed").alias("mean_speed")))


# Q2 without the optional zone columns: only the zone number tells what is in the zone
_BARE_FLAGS = flags_cte().replace("plate_z >= sz_bot AND plate_z <= sz_top, FALSE)", "FALSE)")

register(
    "pitcher_features_minimal",
    f"""{P}, {dedup_cte('pitcher')}, {_BARE_FLAGS}
SELECT 'pitcher' AS role, pitcher AS player_id, year, COUNT(*) AS n_pitches_total, {_PITCHER_SELECT}
FROM f GROUP BY pitcher, year HAVING COUNT(*) >= {PARAMS.min_pitches_pitcher}""",
)(lambda spark, d: finalize(ft.pitcher_features(fx.pitches(spark, d).drop("sz_bot", "sz_top"), PARAMS, with_pitch_types=False)))

register(
    "batter_features_minimal",
    f"""{P}, {dedup_cte('batter')}, {_BARE_FLAGS}
SELECT 'batter' AS role, batter AS player_id, year, COUNT(*) AS n_pitches_total, {_BATTER_SELECT}
FROM f GROUP BY batter, year
HAVING COUNT(*) >= {PARAMS.min_pitches_batter} AND COUNT(CASE WHEN {HAS_LAUNCH} THEN 1 END) >= {PARAMS.min_batted_ball_batter}""",
)(lambda spark, d: finalize(
    ft.batter_features(fx.pitches(spark, d).drop("plate_z", "sz_bot", "sz_top"), PARAMS)))


# Yearly boards landed and read back over a range of years (seasons without a board contribute nothing)
register(
    "leaderboard_years",
    f"""{fx.oracle_ctes('sprint_board')} SELECT year, COUNT(*) AS n_rows, COUNT(player_id) AS n_players, ROUND(AVG(sprint_speed), 10) AS mean_speed
FROM sprint_board WHERE year BETWEEN 1996 AND 1999 GROUP BY year""",
)(lambda spark, d: leaderboard_years(spark, d))


def leaderboard_years(spark, d):
    root = _folder(spark, "boards")
    board = fx.sprint_board(spark, d).drop("file_order")
    status = landing.land_years({lake.SPRINT_DATASET: board}, first_year=1995, last_year=2000, root=root)
    if status["status"] != "ok":
        raise ValueError(f"yearly landing: {status}")
    read = lake.read_leaderboard_years(spark, root, lake.SPRINT_DATASET, 1996, 1999)
    return finalize(read.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("player_id").alias("n_players"), F.avg("sprint_speed").alias("mean_speed")))


# Framing rows need a name
register(
    "framing_named",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS name FROM part WHERE p_partkey % 4 <> 0 AND p_name IS NOT NULL",
)(lambda spark, d: landing.framing_rows(
    fx.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("name"))))


# Deliveries (a month each) one after the other, one of them stale and delivered anew after later ones; the
# features are merged from the stored states, and the pitches of months that a delivery does not touch are not read again
register(
    "season_state",
    f"""{P}, {dedup_cte('pitcher')}, {flags_cte()}
SELECT pitcher AS player_id, year, 'pitcher' AS role, COUNT(*) AS n_pitches_total, {_PITCHER_SELECT}
FROM f GROUP BY pitcher, year HAVING COUNT(*) >= {PARAMS.min_pitches_pitcher}""",
)(lambda spark, d: season_state(spark, d))


def season_state(spark, d):
    src = fx.pitches(spark, d).where(F.col("pitcher").isNotNull()).withColumn("date", F.trunc("game_date", "month").cast("string"))
    bronze, states = _folder(spark, "bronze"), _folder(spark, "states")
    wrong = F.col("date") == "1997-06-01"
    stale = src.where(~wrong | (F.col("row_tiebreak") % 3 != 0)).withColumn("release_speed", F.when(wrong, F.col("release_speed") + 9).otherwise(F.col("release_speed")))

    def read_days(days):
        return lake.read_bronze_range(spark, bronze, min(days), max(days)).where(F.col("date").cast("date").isin(list(days)))

    for part in (stale.where("year <= 1997"), src.where("year > 1997"), src.where(wrong)):
        lake.write_partitioned(part, bronze, ("year", "date"))
        landed = [dt.date.fromisoformat(r[0]) for r in part.select("date").distinct().collect()]
        ss.update(spark, states, "pitcher", read_days, landed, PARAMS)
    return finalize(ss.season(spark, states, "pitcher", dt.date(1995, 1, 1), dt.date(2001, 12, 31), PARAMS, pitches_like=src))


# Stale and corrected copies delivered one after the other; landing shuffles them, and the later one counts.
# Rows without a speed are set aside with their reason while the rest of their day lands
register(
    "landed_corrections",
    f"""{P}, {dedup_cte('pitcher')}
SELECT year, COUNT(release_speed) AS n_kept, ROUND(AVG(release_speed + 1), 10) AS mean_speed,
  (SELECT 2 * COUNT(*) FROM pitches q WHERE q.year = d.year AND q.release_speed IS NULL) AS n_quarantined, 'release_speed' AS reason
FROM d GROUP BY year""".replace(dedup_cte("pitcher"), dedup_cte("pitcher").replace("WHERE pitcher IS NOT NULL", "WHERE pitcher IS NOT NULL AND release_speed IS NOT NULL")),
)(lambda spark, d: landed_corrections(spark, d))


def landed_corrections(spark, d):
    src, month = fx.pitches(spark, d), F.trunc("game_date", "month")
    # rows are put in order before they are widened: by price as by row_tiebreak, which is the price in cents
    lines = fx.table(spark, d, "lineitem").repartitionByRange("l_extendedprice").sortWithinPartitions(F.col("l_shipdate").cast("date"), "l_extendedprice")
    ordered = spark.sql(fx.PITCHES_SQL, lineitem=lines).withColumn("month", month)
    files, bronze, aside = _folder(spark, "delivered"), _folder(spark, "bronze"), _folder(spark, "quarantine")
    for later in (0, 1):  # two deliveries of every pitch, in folders of their own
        copy = ordered.withColumn("release_speed", F.col("release_speed") + later)
        with short_lived_shuffles(spark):
            copy.write.parquet(f"{files}/delivery={later}")
    landed = lake.with_delivery(spark.read.option("basePath", files).parquet(files)).drop("delivery")
    status = landing.land_days(landed, date_col="month", start_date="1995-01-01", end_date="2001-12-31", bronze_root=bronze,
                               required=("pitcher", "release_speed"), quarantine_root=aside)
    if status["status"] != "ok" or status["rows_landed"] + status["rows_quarantined"] != 2 * src.count():
        raise ValueError(f"landing: {status}")
    read = lake.read_bronze_range(spark, bronze, dt.date(1995, 1, 1), dt.date(2001, 12, 31))
    # the place in load order tells any two rows apart
    kept = dedupe_last(lake.with_short_order(read), ("pitcher", "year"), order_cols=("game_date", lake.FILE_ORDER), ties=False)
    kept = kept.groupBy("year").agg(F.count("release_speed").alias("n_kept"), F.avg("release_speed").alias("mean_speed"))
    held = lake.read_partitioned(spark, aside).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_quarantined"), F.max(F.array_join("_reason", ",")).alias("reason"))
    return finalize(kept.join(held, "year"))


# Seven position boards come as CSV with untidy headers and drifting columns, land by year as data
# sets of their own, and are read back over all years and united
register(
    "position_boards",
    f"""{fx.oracle_ctes('field_board')}
SELECT 3 + file_order % 7 AS position, year, player_id, outs_above_average,
  CASE WHEN (3 + file_order % 7) % 2 = 1 THEN actual_success_rate_formatted END AS actual_success_rate_formatted
FROM field_board""",
)(lambda spark, d: position_boards(spark, d))

HEADERS = {"year": "Year", "player_id": " Player ID", "outs_above_average": "Outs Above Average", "actual_success_rate_formatted": "Actual Success Rate (formatted)"}


def position_boards(spark, d):
    board, files, root = fx.field_board(spark, d), _folder(spark, "csv"), _folder(spark, "boards")
    first, last = board.agg(F.min("year"), F.max("year")).first()
    names = {pos: f"oaa_{pos}" for pos in range(3, 10)}
    delivered = {}
    for pos, name in names.items():
        columns = [F.col(c).alias(h) for c, h in HEADERS.items() if pos % 2 or c != "actual_success_rate_formatted"]
        own = board.where(F.col("file_order") % 7 == pos - 3).select(*columns)
        own.write.option("header", True).csv(lake.join_path(files, name))
        delivered[name] = landing.read_leaderboard_csv(spark, lake.join_path(files, name))
    status = landing.land_years(delivered, first_year=first, last_year=last, root=root)
    if status["status"] == "error":  # partial where a year lacks some of the boards
        raise ValueError(f"boards: {status}")
    landed = {pos: lake.read_leaderboard_years(spark, root, name, first, last).drop(lake.FILE_ORDER) for pos, name in names.items()}
    types = {"year": board.schema["year"].dataType, "player_id": board.schema["player_id"].dataType, "outs_above_average": board.schema["outs_above_average"].dataType}
    united = landing.union_position_boards(landed).withColumns({c: F.col(c).cast(t) for c, t in types.items()})
    return united.select(F.col("position").cast("long").alias("position"), *types, F.col("actual_success_rate_formatted").cast("string"))


# 2.11a: a delivery and a later one that corrects the odd pitches, taken up by the stream in a run each; the last copy of each pitch counts
register(
    "stream_corrections",
    f"""{P}, s AS (SELECT date_trunc('month', game_date) AS month, game_pk, at_bat_number, pitch_number, MAX(release_speed) AS speed
      FROM pitches WHERE game_date IS NOT NULL GROUP BY ALL)
SELECT CAST(month AS DATE) AS month, game_pk, at_bat_number, pitch_number, ROUND(speed + pitch_number % 2, 10) AS speed FROM s""",
)(lambda spark, d: stream_corrections(spark, d))


def stream_corrections(spark, d):
    from ..streaming.bronze_stream import land_stream, pitch_stream

    key = ("game_pk", "at_bat_number", "pitch_number")
    src = fx.pitches(spark, d).groupBy(F.trunc("game_date", "month").alias("month"), *key).agg(F.max("release_speed").alias("speed"))
    files, bronze, progress = _folder(spark, "delivered"), _folder(spark, "bronze"), _folder(spark, "progress")
    for run in range(2):
        first = spark.read.schema(src.schema).parquet(f"{files}/run=0") if run else None  # the corrections are made from what was delivered
        delivery = src if first is None else first.where("pitch_number % 2 = 1").withColumn("speed", F.col("speed") + 1)
        delivery.write.parquet(f"{files}/run={run}")
        land_stream(pitch_stream(spark, f"{files}/*", src.schema), bronze_root=bronze, checkpoint_location=progress, date_col="month", key_cols=key).awaitTermination()
    return finalize(lake.read_partitioned(spark, bronze).select("month", *key, "speed"))
