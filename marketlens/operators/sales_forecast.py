"""Sales forecasts by scope and the uplift of coming campaigns, as DataFrame expressions.

``daily`` has (scope, date, gmv). The last, unfinished day is dropped. All scopes are worked in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.calendar import BIG_TIERS, tier
from marketlens.functions.numeric import percent, rounded, slope
from marketlens.operators.series import densify


def _base(daily: DataFrame) -> DataFrame:
    """(scope, date, gmv, i, n, dow, camp): dense days with campaign days marked against a centred median of 15 days."""
    rows = densify(daily, ("gmv",), "scope")
    order = Window.partitionBy("scope").orderBy("date")
    whole = Window.partitionBy("scope")
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(whole)})
    rows = rows.filter((F.col("i") < F.col("n") - 1) | (F.col("n") == 1)).withColumn("n", F.count("*").over(whole))
    middle = F.percentile(F.when(F.col("gmv") > 0, F.col("gmv")), F.lit(0.5)).over(order.rowsBetween(-7, 7))
    return rows.withColumns({"dow": F.dayofweek("date"), "camp": F.coalesce(F.col("gmv") > 1.6 * middle, F.lit(False)), "tier": tier(F.col("date"))})


def _trend(line: str = "") -> Column:
    return F.greatest(F.lit(0.0), F.col("start") + F.col("slope") * F.col("i"))


def sales_forecast(daily: DataFrame, horizon: int = 30) -> dict[str, DataFrame]:
    """``points``, ``facts`` (one row a scope) and ``uplift`` (scope, tier, n, uplift_pct, multiple)."""
    from marketlens.sources.scratch import written

    base = written(_base(daily), "sales-base")
    quiet = ~F.col("camp") & (F.col("gmv") > 0)
    use = quiet & (F.col("i") >= F.col("n") - 180)
    x, y = F.when(use, F.col("i").cast("double")), F.when(use, F.col("gmv"))
    line = base.groupBy("scope").agg(F.coalesce(slope(y, x), F.lit(0.0)).alias("slope"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mx"), F.coalesce(F.avg(y), F.lit(0.0)).alias("my"), F.max("n").alias("n"), F.max("date").alias("last"))
    line = line.withColumn("start", F.col("my") - F.col("slope") * F.col("mx"))
    rows = base.join(line.select("scope", "slope", "start"), "scope").withColumn("t", _trend())
    season = rows.filter(quiet & (F.col("i") >= F.col("n") - 365) & (F.col("t") > 0)).groupBy("scope", "dow").agg(F.percentile(F.col("gmv") / F.col("t"), F.lit(0.5)).alias("w"))
    grid = line.select("scope", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("dow")).join(season, ["scope", "dow"], "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    grid = grid.withColumn("w", F.col("w") / F.avg("w").over(Window.partitionBy("scope")))
    rows = rows.join(grid, ["scope", "dow"]).withColumn("base", F.col("t") * F.col("w"))
    uplift = rows.filter(F.col("tier").isNotNull() & (F.col("gmv") > 0) & (F.col("base") > 0)).groupBy("scope", "tier").agg(F.count("*").alias("n"), F.percentile(F.col("gmv") / F.col("base"), F.lit(0.5)).alias("m"))
    uplift = uplift.select("scope", "tier", "n", rounded((F.col("m") - 1) * 100).alias("uplift_pct"), F.when((F.col("n") >= 2) & (F.col("m") >= 1.1), F.col("m")).otherwise(1.0).alias("multiple"))
    rest = F.when(use, F.col("gmv") - F.col("base"))
    band = rows.groupBy("scope").agg((1.5 * F.sqrt(F.coalesce(F.avg(rest * rest), F.lit(0.0)))).alias("band"))
    past = rows.select("scope", "date", F.col("gmv").alias("actual"), "base", "tier", F.lit(False).alias("is_future"), "camp")
    ahead = line.select("scope", "slope", "start", "n", "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    ahead = ahead.withColumns({"date": F.date_add("last", F.col("h")), "i": F.col("n") - 1 + F.col("h")}).withColumns({"dow": F.dayofweek("date"), "tier": tier(F.col("date"))}).join(grid, ["scope", "dow"])
    ahead = ahead.select("scope", "date", F.lit(None).cast("double").alias("actual"), (_trend() * F.col("w")).alias("base"), "tier", F.lit(True).alias("is_future"), F.lit(False).alias("camp"))
    points = past.unionByName(ahead).join(uplift.select("scope", "tier", "multiple"), ["scope", "tier"], "left").join(band, "scope")
    value = F.col("base") * F.coalesce("multiple", F.lit(1.0))
    points = points.select("scope", "date", "actual", rounded(F.col("base")).alias("baseline"), rounded(value).alias("forecast"), rounded(F.greatest(F.lit(0.0), value - F.col("band"))).alias("lower"), rounded(value + F.col("band")).alias("upper"), F.when(F.col("is_future"), F.coalesce("multiple", F.lit(1.0)) > 1).otherwise(F.col("camp")).alias("is_campaign"), "tier", "is_future")
    points = written(points, "sales-points")
    return {"points": points, "facts": _facts(rows, points), "uplift": uplift}


def _facts(rows: DataFrame, points: DataFrame) -> DataFrame:
    late = lambda a, b: F.sum(F.when((F.col("i") >= F.col("n") - a) & (F.col("i") < F.col("n") - b), F.col("gmv")).otherwise(0.0))
    error = F.when((F.col("i") >= F.col("n") - 30) & ~F.col("camp") & (F.col("gmv") > 0), F.abs(F.col("base") - F.col("gmv")) / F.col("gmv"))
    own = rows.groupBy("scope").agg(F.max("date").alias("last"), late(30, 0).alias("last30"), late(60, 30).alias("prev30"), rounded(F.least(F.lit(100.0), F.avg(error) * 100), 1).alias("mape"), F.count("*").cast("int").alias("days"), F.count_if("camp").alias("campaign_days"))
    year = rows.filter(F.col("i") >= F.col("n") - 30).select("scope", F.date_sub("date", 365).alias("date"), F.col("gmv").alias("now"))
    year = year.join(rows.select("scope", "date", F.col("gmv").alias("was")), ["scope", "date"], "left").groupBy("scope").agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    own = own.join(year, "scope")
    month = points.join(own.select("scope", "last"), "scope").filter(F.trunc("date", "MM") == F.trunc("last", "MM"))
    month = month.groupBy("scope").agg(F.sum(F.when(~F.col("is_future"), F.col("actual")).otherwise(0.0)).alias("month_to_date"), F.sum(F.when(F.col("is_future"), F.col("forecast")).otherwise(0.0)).alias("rest"))
    next30 = points.filter("is_future").groupBy("scope").agg(F.sum("forecast").alias("forecast_ahead"))
    out = own.join(month, "scope").join(next30, "scope")
    return out.select(
        "scope", "days", "campaign_days", rounded(F.col("last30")).alias("last30"), rounded(F.col("prev30")).alias("prev30"), F.coalesce(percent(F.col("last30") - F.col("prev30"), F.nullif(F.col("prev30"), F.lit(0.0))), F.lit(0.0)).alias("mom_pct"),
        percent(F.col("now") - F.col("was"), F.nullif(F.col("was"), F.lit(0.0))).alias("yoy_pct"), "forecast_ahead", rounded(F.col("month_to_date")).alias("month_to_date"), rounded(F.col("month_to_date") + F.col("rest")).alias("month_end"), "mape",
    )


def campaign_uplift(points: DataFrame) -> DataFrame:
    """(scope, date, tier, days_away, baseline, projected, uplift_pct, extra_gmv, is_big) of the events ahead."""
    future = points.filter("is_future")
    first = F.min("date").over(Window.partitionBy("scope"))
    rows = future.withColumn("days_away", F.datediff("date", first) + 1).filter("tier is not null")
    lift = F.when(F.col("baseline") > 0, F.floor(F.try_divide(F.col("forecast") - F.col("baseline"), F.col("baseline")) * 100 + 0.5)).otherwise(0)
    return rows.select("scope", "date", "tier", "days_away", "baseline", F.col("forecast").alias("projected"), lift.alias("uplift_pct"), (F.col("forecast") - F.col("baseline")).alias("extra_gmv"), F.col("tier").isin(BIG_TIERS).alias("is_big"))
