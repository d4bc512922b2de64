"""Filters and the datasets behind an exploration view.

Every dataset takes an (optionally filtered) enriched table; those that only need
sums and counts also take a play cube.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions.binning import derive
from playtrail.functions.nulls import hours, ratio
from playtrail.functions.temporal import weekday_name
from playtrail.operators.histogram import histogram
from playtrail.operators.ranking import top_rows
from playtrail.operators.rollup import EFFICIENCY, mean, measure, rollup, totals
from playtrail.plans import texts
from playtrail.plans.rollups import value_counts

ALL = "All"


# --- filters ----------------------------------------------------------------------


def filter_plays(
    plays: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    content_type: str = ALL,
    platform: str = ALL,
) -> DataFrame:
    """Inclusive date range plus equality filters.

    Filters on the stored ``date`` and, implied by it, ``year``: the first reaches the
    parquet statistics, the second prunes directories of a table partitioned by year.
    """
    out = plays
    for bound, keep in ((start, "ge"), (end, "le")):
        if bound is None:
            continue
        day = date.fromisoformat(bound) if isinstance(bound, str) else bound
        compare = f"__{keep}__"
        out = out.filter(getattr(F.col("date"), compare)(F.lit(day)))
        if "year" in plays.columns:
            out = out.filter(getattr(F.col("year"), compare)(F.lit(day.year)))
    if content_type != ALL:
        out = out.filter(F.col("content_type") == content_type)
    if platform != ALL and "platform_category" in plays.columns:
        out = out.filter(F.col("platform_category") == platform)
    return out


def filter_options(plays: DataFrame) -> DataFrame:
    """One row: date range and the sorted content types and platforms to choose from."""
    return plays.agg(
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.sort_array(F.collect_set("content_type")).alias("content_types"),
        F.sort_array(F.collect_set("platform_category")).alias("platforms"),
    )


# --- overview ---------------------------------------------------------------------


def kpis(plays: DataFrame) -> DataFrame:
    summed = totals(
        plays, ["ms_played", "n_rows"], [EFFICIENCY], {"unique_artists": "artist_name"}
    )
    return summed.select(
        hours(F.col("ms_played")).alias("total_hours"),
        F.col("n_rows").alias("total_plays"),
        "unique_artists",
        F.col(EFFICIENCY).alias("average_efficiency"),
    )


def content_type_counts(plays: DataFrame) -> DataFrame:
    return value_counts(plays, "content_type")


def hours_by_content_type(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["content_type"], ["ms_played"]).select("content_type", "listening_hours")


def top_artists_by_hours(plays: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(rollup(plays, ["artist_name"]), "listening_hours", n, ["artist_name"])


def platform_counts(plays: DataFrame) -> DataFrame:
    return value_counts(plays, "platform_category")


# --- time -------------------------------------------------------------------------


def daily_hours(plays: DataFrame) -> DataFrame:
    if "date" not in plays.columns:
        plays = plays.withColumn("date", F.to_date("timestamp"))
    return rollup(plays, ["date", "content_type"])


def hours_by_time_of_day(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["time_of_day"], dense="time_of_day")


def hour_weekday_heatmap(plays: DataFrame) -> DataFrame:
    """A row per weekday, a column ``h0``..``h23`` per hour, 0 where nothing was played.

    Conditional sums keep this a single map-side-combined aggregate of at most 7 rows.
    """
    cells = plays.dropna(subset=["day_of_week", "hour"])
    total = "coalesce(sum(CASE WHEN hour = {h} THEN ms_played END), 0) / 3600000 AS h{h}"
    return cells.groupBy("day_of_week").agg(*[F.expr(total.format(h=h)) for h in range(24)])


def hours_by_weekday(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["day_of_week", "content_type"])


def hours_by_season(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["season", "content_type"], dense="season")


def plays_by_hour(plays: DataFrame) -> DataFrame:
    counted = rollup(plays, ["hour"], ["n_rows"]).withColumnRenamed("n_rows", "n")
    return counted.orderBy("hour")


def plays_by_weekday(plays: DataFrame) -> DataFrame:
    counted = rollup(plays, ["day_of_week"], ["n_rows"]).withColumnRenamed("n_rows", "n")
    return derive(counted, {"day_name": weekday_name("day_of_week")}).orderBy("day_of_week")


def yearly_trend(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["year", "content_type"])


# --- behaviour --------------------------------------------------------------------


def session_minutes_histogram(
    sessions: DataFrame, bins: int = 30, per: str = "play"
) -> DataFrame:
    """Histogram of session length, each session counted once or once per play.

    Reads the session table, not the plays: counting per play is a weight.
    """
    weight = "n_rows" if per == "play" else None
    return histogram(sessions, "session_duration_minutes", bins, weight)


def session_minutes_by_type(sessions: DataFrame) -> DataFrame:
    """Session length per content type, averaged over plays."""
    weighted = F.sum(F.col("session_duration_minutes") * F.col("n_rows"))
    return sessions.groupBy("content_type").agg(
        ratio(weighted, F.sum("n_rows")).alias("session_duration_minutes")
    )


def efficiency_histogram(plays: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(plays, EFFICIENCY, bins)


def efficiency_by_platform(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["platform_category"], [], [EFFICIENCY])


def skip_rate_by_type_and_time(plays: DataFrame) -> DataFrame:
    return rollup(
        plays, ["time_of_day", "content_type"], ("skips", "plays"), dense="time_of_day"
    )


def platform_hours_by_year(plays: DataFrame) -> DataFrame:
    return rollup(plays, ["year", "platform_category"], ["ms_played"])


# --- headlines --------------------------------------------------------------------


def top_artist(plays: DataFrame) -> DataFrame:
    artists = rollup(plays, ["artist_name"], ["ms_played"])
    return top_rows(artists, "ms_played", 1, ["artist_name"])


def peak_time(plays: DataFrame) -> DataFrame:
    """Time of day with the largest total."""
    times = rollup(plays, ["time_of_day", "time_of_day_ord"], ["ms_played"])
    return top_rows(times, "ms_played", 1, ["time_of_day_ord"]).drop("time_of_day_ord")


def favorite_season(plays: DataFrame) -> DataFrame:
    """Season with the largest total."""
    seasons = rollup(plays, ["season", "season_ord"], ["ms_played"])
    return top_rows(seasons, "ms_played", 1, ["season_ord"]).drop("season_ord")


def key_insight_lines(cube: DataFrame, names: DataFrame) -> DataFrame:
    """Five headline sentences as ``(ord, line)``."""
    summed = cube.agg(measure(cube, "ms_played"), mean(cube, EFFICIENCY)).selectExpr(
        f"stack(2, 1, format_string('{texts.HEADLINE_TIME}', ms_played / 3600000),"
        f" 5, format_string('{texts.HEADLINE_EFFICIENCY}', listening_efficiency * 100))"
        " AS (ord, line)"
    )
    best = top_artist(names).selectExpr(
        "2", f"format_string('{texts.HEADLINE_ARTIST}', artist_name, listening_hours)"
    )
    time = peak_time(cube).selectExpr("3", f"format_string('{texts.HEADLINE_PEAK}', time_of_day)")
    season = favorite_season(cube).selectExpr("4", f"format_string('{texts.HEADLINE_SEASON}', season)")
    return summed.union(best).union(time).union(season)


def summary_report(plays: DataFrame, top: int = 5) -> DataFrame:
    """The text report as ``(section_ord, ord, line)``: title, totals, shares, top artists, an
    empty line before each of these.

    Shares divide small grouped counts by their own sum; nothing per play is ordered.
    """
    summed = totals(plays, ["ms_played", "n_rows"], distinct={"unique_artists": "artist_name"})
    basics = F.array(
        F.lit(texts.BASICS),
        F.format_string(texts.BASIC_HOURS, hours(F.col("ms_played"))),
        F.format_string(texts.BASIC_TRACKS, "n_rows"),
        F.format_string(texts.BASIC_ARTISTS, "unique_artists"),
    )
    sections = [
        summed.select(F.lit(1).alias("section_ord"), F.posexplode(basics).alias("ord", "line"))
    ]

    def numbered(counted: DataFrame, section: int, title: str, line) -> DataFrame:
        """A heading and one line per entry of an ordered array of small structs."""
        body = F.transform(F.col("entries"), line)
        listing = F.concat(F.array(F.lit(title)), body)
        return counted.select(F.lit(section), F.posexplode(listing))

    def shares(column: str, section: int, title: str) -> DataFrame:
        # One entry per value of a closed domain; negative counts sort descending.
        # Rows without a value have no line, but shares are of all rows.
        counts = plays.groupBy(column).agg(measure(plays, "n_rows"))
        named = F.when(
            F.col(column).isNotNull(),
            F.struct((-F.col("n_rows")).alias("neg"), F.col(column).alias("name")),
        )
        ordered = F.sort_array(F.collect_list(named))
        packed = counts.agg(ordered.alias("entries"), F.sum("n_rows").alias("total"))

        def line(entry):
            count = -entry["neg"]
            percent = ratio(count, F.col("total")) * 100
            return F.format_string(texts.SHARE, entry["name"], count, percent)

        return numbered(packed, section, title, line)

    sections.append(shares("content_type", 2, texts.TYPES))

    artists = rollup(plays, ["artist_name"], ["ms_played"])
    best = top_rows(artists, "ms_played", top, ["artist_name"])
    packed = best.agg(
        F.sort_array(
            F.collect_list(
                F.struct((-F.col("ms_played")).alias("neg"), F.col("artist_name").alias("name"))
            )
        ).alias("entries")
    )
    heading = packed.select(
        F.lit(3),
        F.posexplode(
            F.concat(
                F.array(F.lit(texts.TOP_ARTISTS.format(n=top))),
                F.transform(
                    F.col("entries"),
                    lambda e, i: F.format_string(
                        texts.RANKED_ARTIST, i + 1, e["name"], hours(-e["neg"])
                    ),
                ),
            )
        ),
    )
    sections.append(heading)
    sections.append(shares("platform_category", 4, texts.PLATFORMS))

    layout = [(0, k, line) for k, line in enumerate(texts.TITLE)]
    layout += [(k, -1, "") for k in range(1, len(sections) + 1)]
    out = plays.sparkSession.createDataFrame(layout, "section_ord int, ord int, line string")
    for section in sections:
        out = out.union(section)
    return out
