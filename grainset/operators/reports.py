"""Time-series metric reports: period means, gap-filled quarters, daily trends.

Input is a *metric frame*: one row per record with a wall-clock timestamp, an
author (or any grouping key) and numeric metric columns. Every report is a
partial-aggregate ``groupBy`` on a calendar key, so the shuffle carries one row
per (task, key) and a hot author or period is combined map-side. Whatever runs
after the aggregate (trend fits, gap filling) works on tables whose size is
bounded by the calendar (periods x groups), not by the record count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..session import broadcast_if_small

PERIODS = {
    "month": ("year_month", dates.month_key),
    "week": ("year_week", dates.week_key),
    "day": ("day", dates.utc_day),
}


def _mean_cols(metrics, suffix="avg_", ndigits=None):
    out = []
    for m in metrics:
        e = F.avg(F.col(m))
        if ndigits is not None:
            e = F.round(e, ndigits)
        out.append(e.alias(f"{suffix}{m}"))
    return out


def period_means(
    df: DataFrame,
    metrics: list[str],
    period: str = "month",
    ts_col: str = "date",
    by: list[str] | None = None,
    ndigits: int | None = None,
) -> DataFrame:
    """Mean of each metric per period (and per ``by`` keys); null group keys excluded.

    ``period``: 'month' ('%Y-%m'), 'week' ('%Y-W%U'), 'day' (calendar day of ``ts_col``).
    """
    key_name, key_fn = PERIODS[period]
    by = list(by or [])
    src = df
    for b in by:
        src = src.filter(F.col(b).isNotNull())
    # Null keys form no group (as in a pandas group-by).
    src = src.select(key_fn(F.col(ts_col)).alias(key_name), *by, *metrics).filter(F.col(key_name).isNotNull())
    return src.groupBy(key_name, *by).agg(*_mean_cols(metrics, ndigits=ndigits))


def quarterly_means(
    df: DataFrame, metric: str, ts_col: str = "date", ndigits: int | None = None, label: str = "quarter_end",
    by: list[str] | None = None,
) -> DataFrame:
    """Quarter means labelled by the quarter end date; empty quarters between the first
    and last (of each ``by`` group; null groups are left out) appear with a null mean."""
    by = list(by or [])
    q = df.select(dates.quarter_start(F.col(ts_col)).alias("__q"), *by, F.col(metric))
    q = q.dropna(subset=["__q", *by])
    agg = q.groupBy(*by, "__q").agg(*_mean_cols([metric], ndigits=ndigits))
    span = agg.groupBy(*by).agg(F.min("__q").alias("lo"), F.max("__q").alias("hi"))
    calendar = span.select(
        *by, F.explode(F.sequence(F.col("lo"), F.col("hi"), F.expr("INTERVAL 3 MONTHS"))).alias("__q")
    )
    out = calendar.join(agg, [*by, "__q"], "left")
    return out.select(*by, dates.quarter_end(F.col("__q")).alias(label), f"avg_{metric}")


def _fit(points: DataFrame, keys: list[str], x: str, y: str, ndigits: int | None) -> DataFrame:
    """Least-squares line y = a + b*x per key group, fitted value per point."""
    fit = points.groupBy(*keys).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
    )
    fit = broadcast_if_small(fit)
    out = points.join(fit, keys, "inner") if keys else points.crossJoin(F.broadcast(fit))
    fitted = F.when(F.col("slope").isNull(), F.col(y)).otherwise(F.col("intercept") + F.col("slope") * F.col(x))
    cols = [F.col(c) for c in points.columns]
    extra = [fitted.alias("trend"), F.col("slope"), F.col("intercept")]
    if ndigits is not None:
        extra = [F.round(e, ndigits).alias(n) for e, n in zip([fitted, F.col("slope"), F.col("intercept")],
                                                               ["trend", "slope", "intercept"])]
    return out.select(*cols, *extra)


def daily_trend(
    df: DataFrame,
    metric: str,
    ts_col: str = "date",
    ndigits: int | None = None,
) -> DataFrame:
    """Daily mean of ``metric`` with a linear trend over the day *position* 0..n-1."""
    daily = df.filter(F.col(ts_col).isNotNull()).groupBy(dates.utc_day(F.col(ts_col)).alias("day")).agg(
        F.avg(metric).alias("avg_value"))
    # The daily table has one row per calendar day (bounded); numbering it in one
    # window is cheap and keeps the x-axis exactly the sorted day index.
    daily = daily.withColumn("x", (F.row_number().over(Window.orderBy("day")) - 1).cast("int"))
    out = _fit(daily, [], "x", "avg_value", ndigits)
    if ndigits is not None:
        out = out.withColumn("avg_value", F.round("avg_value", ndigits))
    return out


def author_daily_trend(
    df: DataFrame,
    metric: str,
    ts_col: str = "date",
    author_col: str = "author",
    min_records: int = 2,
    min_days: int = 2,
    ndigits: int | None = None,
) -> DataFrame:
    """Per author: daily means and trend, skipping authors with fewer than
    ``min_records`` records, then those with fewer than ``min_days`` days."""
    src = df.filter(F.col(author_col).isNotNull() & F.col(ts_col).isNotNull())
    per_day = src.groupBy(F.col(author_col).alias("author"), dates.utc_day(F.col(ts_col)).alias("day")).agg(
        F.avg(metric).alias("avg_value"), F.count(F.lit(1)).alias("n")
    )
    w_author = Window.partitionBy("author")
    # Window per author over the (author, day) table: at most one row per calendar day.
    per_day = per_day.withColumn("n_records", F.sum("n").over(w_author)).withColumn(
        "n_days", F.count(F.lit(1)).over(w_author)
    )
    kept = per_day.filter((F.col("n_records") >= min_records) & (F.col("n_days") >= min_days))
    kept = kept.withColumn(
        "x", (F.row_number().over(Window.partitionBy("author").orderBy("day")) - 1).cast("int")
    ).select("author", "day", "x", "avg_value")
    out = _fit(kept, ["author"], "x", "avg_value", ndigits)
    if ndigits is not None:
        out = out.withColumn("avg_value", F.round("avg_value", ndigits))
    return out


def metrics_long(df: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    """Unpivot metric columns to (metric, value) rows so one aggregation serves all."""
    casted = df.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics])
    return casted.unpivot(keep, metrics, "metric", "value")


def period_means_long(
    df: DataFrame, metrics: list[str], period: str = "month", ts_col: str = "date", ndigits: int | None = None
) -> DataFrame:
    """Same period report for several metrics in one pass (long form)."""
    key_name, key_fn = PERIODS[period]
    keyed = df.withColumn(key_name, key_fn(F.col(ts_col))).filter(F.col(key_name).isNotNull())
    long = metrics_long(keyed, metrics, [key_name])
    e = F.avg("value")
    if ndigits is not None:
        e = F.round(e, ndigits)
    return long.groupBy(key_name, "metric").agg(e.alias("avg_value"))


def child_sum_rollup(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, measure: str, name: str
) -> DataFrame:
    """Per parent: sum of a child measure, missing children or measures count as 0.

    The children are pre-aggregated on their key (map-side combine) before the join,
    so a parent with a third of all children still ships one partial row per task.
    """
    per_parent = children.groupBy(F.col(child_key).alias("__k")).agg(
        F.sum(F.coalesce(F.col(measure), F.lit(0))).alias("__s")
    )
    out = parents.join(per_parent, parents[parent_key] == per_parent["__k"], "left")
    return out.select(parents[parent_key], F.coalesce(F.col("__s"), F.lit(0)).alias(name))


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def group_counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def utc_from_offset_text(iso_text: Column) -> Column:
    """UTC wall-clock of an ISO text with a '+HH:MM' / 'Z' suffix; null without offset."""
    wall = dates.wall_clock(iso_text)
    m = F.regexp_extract(iso_text, r"([+-])(\d{2}):?(\d{2})$", 0)
    sign = F.when(F.regexp_extract(iso_text, r"([+-])(\d{2}):?(\d{2})$", 1) == "-", -1).otherwise(1)
    hh = F.regexp_extract(iso_text, r"([+-])(\d{2}):?(\d{2})$", 2).try_cast("int")
    mm = F.regexp_extract(iso_text, r"([+-])(\d{2}):?(\d{2})$", 3).try_cast("int")
    minutes = sign * (hh * 60 + mm)
    has_z = iso_text.endswith("Z")
    shifted = F.timestamp_add("MINUTE", -minutes, wall)
    return F.when(has_z, wall).when(m != "", shifted)
