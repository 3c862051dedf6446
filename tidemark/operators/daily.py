"""From raw observations and events to one row per site and day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.risk import calendar
from tidemark.session import materialise, shuffle_partitions

KEYS = ("site", "day")


def study_period(df: DataFrame, ts: str, first_year: int, last_year: int) -> DataFrame:
    """Rows of the years ``first_year`` to ``last_year``, both included.

    A half-open range on the bare column, in the column's own type, so the scan can skip row groups.
    """
    kind = df.schema[ts].dataType
    low = F.lit(f"{first_year:04d}-01-01").cast(kind)
    high = F.lit(f"{last_year + 1:04d}-01-01").cast(kind)
    return df.where((F.col(ts) >= low) & (F.col(ts) < high))


def daily_max(df: DataFrame, site: str, ts: str, values: dict[str, Column]) -> DataFrame:
    """Daily maximum per site of each named expression. Partial maxima are formed before the shuffle."""
    return df.groupBy(F.col(site).alias("site"), F.to_date(ts).alias("day")).agg(
        *[F.max(expr).alias(name) for name, expr in values.items()]
    )


def with_calendar(df: DataFrame, day: str = "day") -> DataFrame:
    return df.withColumns(calendar(F.col(day)))


def day_limits(df: DataFrame, ts: str) -> tuple[Column, Column]:
    """First and last day of a table as scalar subqueries: one narrow pass, shared by both."""
    seen = df.agg(F.to_date(F.min(ts)).alias("lo"), F.to_date(F.max(ts)).alias("hi"))
    return seen.select("lo").scalar(), seen.select("hi").scalar()


def _day(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def _filled(daily: DataFrame, lo: Column, hi: Column, zero: Sequence[str], listed: str | None = None) -> DataFrame:
    """The rows of ``daily`` and the missing days; sites whose first row has ``listed`` = 0 are left out."""
    values = [c for c in daily.columns if c not in KEYS and c != listed]
    order = Window.partitionBy("site").orderBy("day")
    spans = (
        daily.repartition(shuffle_partitions(daily.sparkSession), "site")
        .withColumn("_keep", F.first(listed).over(order) == 1 if listed else F.lit(True))
        .withColumn("_next", F.lead("day").over(order))
        .withColumn("_from", F.when(F.row_number().over(order) == 1, lo).otherwise(F.col("day")))
        .withColumn("_to", F.coalesce(F.date_sub("_next", 1), hi))
        .where("_keep")
    )
    filled = spans.select(
        "site", F.col("day").alias("_seen"), *values, F.explode(F.sequence("_from", "_to")).alias("day")
    )
    real = F.col("day") == F.col("_seen")
    out = [
        (F.when(real, F.col(c)).otherwise(0) if c in zero else F.when(real, F.col(c))).alias(c) for c in values
    ]
    return filled.select("site", "day", *out)


def fill_days(daily: DataFrame, start, end, zero: Sequence[str] = ()) -> DataFrame:
    """Add the missing days of every site, so that each has all days from ``start`` to ``end``.

    The limits are dates, or columns as from ``day_limits``. Rows outside them are dropped. ``daily``
    holds at most one row per (site, day). Each row generates itself and the gap behind it, so only
    the rows that exist are shuffled, by site, and the far larger calendar never is. Added rows are
    null but for the columns in ``zero``, which become 0. A site contributes at most one row per day,
    which bounds the window. The explicit partition count keeps small inputs from being merged into a
    few tasks before they expand.
    """
    lo, hi = _day(start), _day(end)
    return _filled(daily.where((F.col("day") >= lo) & (F.col("day") <= hi)), lo, hi, zero)


def daily_panel(
    sites: DataFrame, events: DataFrame, ts: str, start, end, observations: Sequence[DataFrame] = ()
) -> DataFrame:
    """Outcome and daily maxima of all observations, for every day and site of the period.

    ``sites`` has one column ``site`` (repeats allowed); ``events`` has ``site`` and the timestamp
    ``ts``; each observation has ``site``, ``day`` and its own value columns, with any number of rows
    per day. ``y`` is 1 on days with an event, else 0; values are null on days without any. Sites
    without events are kept; rows at other sites or outside the period are not. The limits are dates,
    or columns as from ``day_limits``.

    All sources meet in one aggregate instead of a join each: partial maxima are shuffled once by
    (site, day) and once by site, where the calendar is then filled in.
    """
    lo, hi = _day(start), _day(end)
    # Every site is listed on the first day of the period: its first row then tells whether it counts.
    rows = sites.select("site", lo.alias("day"), F.lit(0).alias("y"), F.lit(1).alias("_listed"))
    marks = events.select("site", F.to_date(ts).alias("day"), F.lit(1).alias("y"))
    for source in (marks, *observations):
        rows = rows.unionByName(source, allowMissingColumns=True)
    rows = rows.where(F.col("site").isNotNull() & (F.col("day") >= lo) & (F.col("day") <= hi))
    values = [c for c in rows.columns if c not in (*KEYS, "y", "_listed")]
    daily = rows.groupBy("site", "day").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("y", "_listed")], *[F.max(c).alias(c) for c in values]
    )
    return _filled(daily, lo, hi, ["y"], "_listed")


def daily_outcome(sites: DataFrame, events: DataFrame, ts: str, start, end) -> DataFrame:
    """1 for each day and site with an event, 0 for every other day: ``daily_panel`` without observations."""
    return daily_panel(sites, events, ts, start, end)


def unfolded_panel(
    df: DataFrame,
    site: str,
    ts: str,
    event: Column,
    values: Mapping[str, Column] = {},
    ahead: Mapping[str, Column] = {},
    lead: int = 3,
) -> DataFrame:
    """``daily_panel`` where one table holds sites, events, observations and forecasts, which is then read once.

    Each row unfolds into what it contributes: to its own day whether it is an ``event`` and the observed ``values``, and to the day
    ``lead`` days later what it predicts, ``ahead``. One aggregate of these by site and day is written; it also
    holds the first and last day, so no other pass over the table is needed. Every site of the table is listed, also one without any
    day; rows without a site are left out. A condition that is null is no event, and daily maxima ignore nulls.
    """
    day = F.to_date(ts)
    names = [*values, *ahead]
    none = {n: F.lit(None).cast(df.select(c.alias(n)).schema[n].dataType) for n, c in {**values, **ahead}.items()}

    def contribution(at: Column, y: Column, own: int, given: Mapping[str, Column]) -> Column:
        return F.struct(at.alias("day"), y.alias("y"), F.lit(own).alias("_own"), *[given.get(n, none[n]).alias(n) for n in names])

    known = day.isNotNull()
    parts = [contribution(day, F.when(known & event, 1).otherwise(0), 1, {n: F.when(known, c) for n, c in values.items()})]
    if ahead:
        parts.append(contribution(F.date_add(day, lead), F.lit(0), 0, ahead))
    rows = df.where(F.col(site).isNotNull()).select(F.col(site).alias("site"), F.inline(F.array(*parts)))
    daily = materialise(rows.groupBy("site", "day").agg(*[F.max(c).alias(c) for c in ("y", "_own", *names)]), "daily")
    limits = daily.where("_own = 1").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    lo, hi = limits.select("lo").scalar(), limits.select("hi").scalar()
    dated = daily.where((F.col("day") >= lo) & (F.col("day") <= hi))
    undated = daily.where("day is null")
    if not undated.isEmpty():  # sites that have no day of their own start on the first one
        bare = undated.select("site").join(dated.select("site").distinct(), "site", "left_anti")
        dated = dated.unionByName(bare.select("site", lo.alias("day"), F.lit(0).alias("y")), allowMissingColumns=True)
    return _filled(dated.drop("_own"), lo, hi, ["y"])


def modelling_table(outcome: DataFrame, *features: DataFrame) -> DataFrame:
    """Outcome rows with the daily features of the same site and day; days without them keep nulls.

    Daily frames come out of ``groupBy(site, day)`` already partitioned by the join keys, so only the
    outcome is exchanged, once for all joins. To build outcome and features together, without that
    exchange, use ``daily_panel``.
    """
    out = outcome
    for f in features:
        out = out.join(f, list(KEYS), "left")
    return with_calendar(out)


def lead_forecast(days: DataFrame, forecasts: DataFrame, value: str, lead: int = 3) -> DataFrame:
    """For each (site, day), the value predicted ``lead`` days earlier.

    ``forecasts`` has ``site``, ``issue_day`` and the value; the daily maximum of several issues of
    one day is taken. Days without such a prediction get null.
    """
    due = forecasts.groupBy("site", F.date_add("issue_day", lead).alias("day")).agg(F.max(value).alias(value))
    return days.join(due, list(KEYS), "left")
