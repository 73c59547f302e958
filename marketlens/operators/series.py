"""Daily series by product: density, patterns, stock science, elasticity, life cycle, months and signals.

A series has (product_id, date, units[, gmv]), one row a product and day. All products are worked in one job; windows
are by product, so nothing is shuffled again once a series is dealt by product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numeric import correlation, normal_cdf, rounded, slope, strength


def by_day():
    return Window.partitionBy("product_id").orderBy("date")


def densify(series: DataFrame, values: tuple[str, ...] = ("units", "gmv"), key: str = "product_id") -> DataFrame:
    """Every day between a product's first and last, missing ones with 0."""
    span = series.groupBy(key).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(key, F.explode(F.sequence("lo", "hi")).alias("date"))
    return days.join(series, [key, "date"], "left").select(key, "date", *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))


def _sd(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def demand_pattern(dense: DataFrame, least: int = 14) -> DataFrame:
    """Syntetos-Boylan classes from the mean interval between sales and the variation of their sizes."""
    size = F.when(F.col("units") > 0, F.col("units"))
    rows = dense.groupBy("product_id").agg(F.count("*").alias("n"), F.count(size).alias("nz"), F.avg(size).alias("m"), _sd(size).alias("sd")).filter(F.col("n") >= least)
    rare = F.col("nz") < 3
    cv = F.col("sd") / F.when(F.coalesce("m", F.lit(0.0)) == 0, 1.0).otherwise(F.col("m"))
    rows = rows.select("product_id", "n", "nz", F.when(rare, F.col("n").cast("double")).otherwise(rounded(F.try_divide(F.col("n"), F.col("nz")), 2)).alias("adi"), F.when(rare, 0.0).otherwise(rounded(cv * cv, 2)).alias("cv2"))
    gap, wild = F.col("adi") >= 1.32, F.col("cv2") >= 0.49
    kind = F.when(F.col("nz") < 3, "rare").when(~gap & ~wild, "smooth").when(gap & ~wild, "intermittent").when(~gap & wild, "erratic").otherwise("lumpy")
    return rows.withColumn("pattern", kind)


#: Normal quantiles of service levels: fixed values.
Z = {90: 1.2816, 95: 1.6449, 99: 2.3263}


def stock_science(dense: DataFrame, stock: DataFrame, lead: int, window: int = 90) -> DataFrame:
    """(product_id, service, safety, reorder_point, mean_daily, sigma_daily, stockout_risk, recommended_service)."""
    late = dense.withColumn("r", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("date")))).filter(F.col("r") <= window)
    rates = late.groupBy("product_id").agg(F.avg("units").alias("m"), _sd(F.col("units")).alias("sd")).join(stock, "product_id", "left")
    sigma = F.col("sd") * float(lead**0.5)
    risk = F.when(F.col("stock").isNotNull() & (sigma > 0), rounded((1 - normal_cdf(F.try_divide(F.col("stock") - F.col("m") * lead, sigma))) * 100, 1))
    cv = F.when(F.col("m") > 0, F.try_divide(F.col("sd"), F.col("m"))).otherwise(0.0)
    rows = rates.withColumns({"risk": risk, "advice": F.when(cv > 1, 99).when(cv > 0.5, 95).otherwise(90)})
    table = F.explode(F.array(*[F.struct(F.lit(s).alias("service"), F.ceil(F.lit(z) * sigma).cast("int").alias("safety")) for s, z in Z.items()])).alias("s")
    rows = rows.select("product_id", table, "m", "sd", "risk", "advice")
    point = F.ceil(F.col("m") * lead + F.col("s.safety")).cast("int")
    return rows.select("product_id", "s.service", "s.safety", point.alias("reorder_point"), rounded(F.col("m"), 2).alias("mean_daily"), rounded(F.col("sd"), 2).alias("sigma_daily"), F.col("risk").alias("stockout_risk"), F.col("advice").alias("recommended_service"))


def reorder_plan(science: DataFrame, stock: DataFrame, lead: int, service: int = 95, target: int = 30) -> DataFrame:
    """Cover, status and the quantity to order at a service level."""
    rows = science.filter(F.col("service") == service).join(stock, "product_id", "left").withColumn("held", F.coalesce("stock", F.lit(0.0)))
    cover = F.when(F.col("stock").isNotNull() & (F.col("mean_daily") > 0), F.floor(F.try_divide(F.col("stock"), F.col("mean_daily")) + 0.5).cast("int"))
    rows = rows.withColumn("cover", cover)
    status = F.when(F.col("stock").isNull(), "nostock").when(F.col("cover").isNull(), "dead").when(F.col("cover") <= lead, "urgent").when(F.col("cover") <= 2 * lead, "soon").when(F.col("cover") >= 120, "overstock").otherwise("ok")
    quantity = F.greatest(F.lit(0), F.ceil(F.col("mean_daily") * (lead + target) + F.col("safety") - F.col("held"))).cast("int")
    return rows.select("product_id", "cover", status.alias("status"), quantity.alias("order_qty"))


def forecast_quality(pairs: DataFrame, least: int = 7) -> DataFrame:
    """WAPE, MAPE over positive actuals, bias, RMSE and a grade, by product, from (product_id, actual, forecast)."""
    rows = pairs.filter("actual is not null").withColumn("e", F.col("forecast") - F.col("actual"))
    total = F.sum("actual")
    share = lambda x: F.when(total > 0, rounded(F.try_divide(x, total) * 100, 1)).otherwise(0.0)
    out = rows.groupBy("product_id").agg(
        F.count("*").alias("n"), share(F.sum(F.abs("e"))).alias("wape"), rounded(F.avg(F.when(F.col("actual") > 0, F.try_divide(F.abs("e"), F.col("actual")))) * 100, 1).alias("mape"), share(F.sum("e")).alias("bias"), rounded(F.sqrt(F.avg(F.col("e") * F.col("e"))), 1).alias("rmse")
    )
    grade = F.when(F.col("wape") <= 20, "high").when(F.col("wape") <= 35, "good").when(F.col("wape") <= 50, "fair").otherwise("caution")
    return out.filter(F.col("n") >= least).withColumn("grade", grade)


def weekly(series: DataFrame, start: Column | None = None) -> DataFrame:
    """(product_id, week, units): sums by weeks counted from the product's first day."""
    first = F.min("date").over(Window.partitionBy("product_id")) if start is None else start
    return series.withColumn("week", F.floor(F.datediff("date", first) / 7).cast("int")).groupBy("product_id", "week").agg(F.sum("units").alias("units"))


def lifecycle_stage(series: DataFrame) -> DataFrame:
    """(product_id, stage, age_days, recent_vs_peak_pct) from weekly sums; a last week that isn't full is dropped."""
    span = series.groupBy("product_id").agg(F.count("*").alias("rows"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("age_days")).filter(F.col("rows") >= 28)
    weeks = weekly(series.join(span.select("product_id"), "product_id", "left_semi")).join(span, "product_id")
    back, ahead = Window.partitionBy("product_id").orderBy(F.desc("week")), Window.partitionBy("product_id").orderBy("week")
    weeks = weeks.withColumns({"rank": F.row_number().over(back), "weeks": F.count("*").over(Window.partitionBy("product_id"))})
    short = ((F.col("age_days") - 1) % 7 < 6) & (F.col("weeks") > 5)
    weeks = weeks.filter(~(short & (F.col("rank") == 1)))
    weeks = weeks.withColumns({"rank": F.row_number().over(back), "nth": F.row_number().over(ahead), "weeks": F.count("*").over(Window.partitionBy("product_id"))}).filter(F.col("weeks") >= 4)
    tail = F.when(F.col("rank") <= 8, F.col("units"))
    at = F.when(F.col("rank") <= 8, -F.col("rank").cast("double"))
    facts = weeks.groupBy("product_id").agg(
        F.max("age_days").alias("age_days"), F.max("units").alias("peak"), F.avg(F.when(F.col("rank") <= 4, F.col("units"))).alias("recent"), F.avg(F.when(F.col("nth") <= 4, F.col("units"))).alias("early"), slope(tail, at).alias("slope"), F.avg(tail).alias("level")
    )
    facts = facts.withColumns({"trend": F.when(F.col("level") > 0, F.try_divide(F.col("slope"), F.col("level"))).otherwise(0.0), "recent_vs_peak_pct": F.when(F.col("peak") > 0, rounded(F.try_divide(F.col("recent"), F.col("peak")) * 100)).otherwise(0.0)})
    stage = (
        F.when(F.col("age_days") <= 45, "new")
        .when((F.col("trend") > 0.04) & (F.col("recent") >= F.col("early")), "growing")
        .when((F.col("recent_vs_peak_pct") < 55) & (F.col("trend") < -0.02), "declining")
        .when((F.col("trend") > 0.04) & (F.col("recent_vs_peak_pct") < 70), "recovering")
        .otherwise("mature")
    )
    return facts.select("product_id", stage.alias("stage"), "age_days", "recent_vs_peak_pct")


def price_elasticity(series: DataFrame, least: int = 30) -> DataFrame:
    """Log-log elasticity of units to price with its t value, R2, sensitivity and the lift of promoted days."""
    days = series.filter((F.col("units") > 0) & (F.col("gmv") > 0)).withColumn("price", F.col("gmv") / F.col("units"))
    days = days.withColumns({"x": F.log("price"), "y": F.log("units")})
    facts = days.groupBy("product_id").agg(
        F.count("*").alias("n"), F.avg("price").alias("avg"), F.min("price").alias("lo"), F.max("price").alias("hi"), _sd(F.col("price")).alias("sd"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"), F.percentile("price", F.lit(0.5)).alias("med")
    ).filter(F.col("n") >= least)
    b = F.coalesce(F.try_divide(F.col("cxy"), F.col("vx")), F.lit(0.0))
    facts = facts.withColumns({"b": b, "threshold": rounded(F.col("med") * 0.95, 2)})
    # residual sum of squares over n
    facts = facts.withColumn("res", F.greatest(F.col("vy") - F.col("b") * F.col("cxy"), F.lit(0.0)))
    error = F.sqrt(F.try_divide(F.col("res") * F.col("n") / (F.col("n") - 2), F.col("vx") * F.col("n")))
    facts = facts.withColumns({"t": F.coalesce(F.try_divide(F.col("b"), error), F.lit(0.0)), "r2": F.coalesce(1 - F.try_divide(F.col("res"), F.col("vy")), F.lit(0.0))})
    promo = days.join(facts.select("product_id", "threshold"), "product_id").groupBy("product_id").agg(
        *(f(F.when(cond, F.col("units"))).alias(name) for cond, tag in ((F.col("price") <= F.col("threshold"), "p"), (F.col("price") > F.col("threshold"), "o")) for f, name in ((F.count, f"n_{tag}"), (lambda c: F.percentile(c, F.lit(0.5)), f"m_{tag}")))
    )
    rows = facts.join(promo, "product_id")
    lift = F.when((F.col("n_p") >= 3) & (F.col("n_o") >= 3) & (F.col("m_o") > 0), rounded(F.try_divide(F.col("m_p") - F.col("m_o"), F.col("m_o")) * 100))
    flat = F.coalesce(F.try_divide(F.col("sd"), F.col("avg")), F.lit(0.0)) < 0.02
    clear = (F.abs("t") >= 2) & ~flat
    kind = F.when(~clear, "unclear").when(F.abs("b") >= 1, "high").when(F.abs("b") >= 0.4, "medium").otherwise("inelastic")
    zero = lambda c: F.when(flat, 0.0).otherwise(c)
    return rows.select(
        "product_id", "n", rounded(F.col("avg"), 2).alias("avg_price"), zero(rounded(F.col("b"), 2)).alias("elasticity"), zero(rounded(F.col("t"), 1)).alias("t"), clear.alias("significant"), zero(rounded(F.col("r2"), 2)).alias("r2"), kind.alias("sensitivity"),
        F.when(~flat, lift).alias("promo_lift_pct"), F.when(~flat, F.col("threshold")).alias("promo_threshold"),
    )


def reconstruct_demand(dense: DataFrame, stock_history: DataFrame | None = None) -> DataFrame:
    """Daily demand with days that ran out of stock filled by the median sale: (product_id, date, units, imputed).

    With a history (product_id, date, stock), days without stock and sales are filled. Without one, runs of empty days
    between sales that are long for the product (2.5 times its median gap, three days at least) are.
    """
    sold = F.col("units") > 0
    facts = dense.groupBy("product_id").agg(F.count("*").alias("n"), F.count_if(sold).alias("nz"), F.percentile(F.when(sold, F.col("units")), F.lit(0.5)).alias("rate")).filter((F.col("n") >= 21) & (F.col("nz") >= 3))
    rows = dense.join(facts.select("product_id", F.floor(F.col("rate") + 0.5).alias("fill")), "product_id")
    if stock_history is not None:
        held = stock_history.select("product_id", "date", "stock")
        rows = rows.join(held, ["product_id", "date"], "left").withColumn("imputed", F.coalesce(F.col("stock") <= 0, F.lit(False)) & (F.col("units") == 0))
    else:
        island = F.count_if(sold).over(by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("island", island)
        whole = Window.partitionBy("product_id")
        rows = rows.withColumns({"last": F.max("island").over(whole), "length": F.count_if(~sold).over(Window.partitionBy("product_id", "island"))})
        # a gap between sales is the run of empty days after a sale, plus one
        gaps = rows.filter(sold & (F.col("island") < F.col("last"))).groupBy("product_id").agg(F.percentile(F.col("length") + 1, F.lit(0.5)).alias("gap"))
        limit = F.greatest(F.lit(3), F.ceil(F.greatest(F.lit(1.0), F.col("gap")) * 2.5))
        rows = rows.join(gaps, "product_id").withColumn("imputed", ~sold & (F.col("island") > 0) & (F.col("island") < F.col("last")) & (F.col("length") >= limit))
    return rows.select("product_id", "date", F.when(F.col("imputed"), F.col("fill").cast("double")).otherwise(F.col("units")).alias("units"), "imputed")


def reconstruction_summary(rebuilt: DataFrame) -> DataFrame:
    seen = F.sum(F.when(~F.col("imputed"), F.col("units")).otherwise(0.0))
    added = F.sum(F.when(F.col("imputed"), F.col("units")).otherwise(0.0))
    lift = F.when(seen > 0, rounded(F.try_divide(added, seen) * 100, 1)).otherwise(0.0)
    return rebuilt.groupBy("product_id").agg(F.count_if("imputed").alias("stockout_days"), added.alias("imputed_units"), seen.alias("observed_units"), lift.alias("uplift_pct"))


def lost_sales(future: DataFrame, stock: DataFrame, lead: int, price: DataFrame) -> DataFrame:
    """Cover, stock-out date and what is lost by lead time and horizon, from future (product_id, date, units)."""
    rows = future.join(stock.filter("stock is not null"), "product_id").withColumns({"k": F.row_number().over(by_day()), "run": F.sum("units").over(by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    out = F.col("run") > F.col("stock")
    facts = rows.groupBy("product_id").agg(
        F.max("stock").alias("stock"), F.min(F.when(out, F.col("k"))).alias("cover_days"), F.min(F.when(out, F.col("date"))).alias("stockout_date"), F.sum(F.when(F.col("k") <= lead, F.col("units")).otherwise(0.0)).alias("need"), F.sum("units").alias("total")
    ).join(price, "product_id", "left")
    lost = F.greatest(F.lit(0.0), F.floor(F.col("need") - F.col("stock") + 0.5).cast("double"))
    risk = F.greatest(F.lit(0.0), F.floor(F.col("total") - F.col("stock") + 0.5).cast("double"))
    facts = facts.withColumns({"lost_units": lost, "risk_units": risk, "p": F.coalesce("unit_price", F.lit(0.0))})
    level = F.when(F.col("lost_units") > 0, "high").when(F.col("cover_days") <= lead * 1.5, "low").otherwise("none")
    return facts.select(
        "product_id", "cover_days", "stockout_date", rounded(F.col("need")).alias("demand_lead_time"), rounded(F.least("stock", "need")).alias("servable"), "lost_units", rounded(F.col("lost_units") * F.col("p")).alias("lost_revenue"), F.col("risk_units").alias("horizon_at_risk_units"), rounded(F.col("risk_units") * F.col("p")).alias("horizon_at_risk_revenue"), level.alias("level")
    )


def monthly(series: DataFrame) -> DataFrame:
    """(product_id, month, units): dense months."""
    sums = series.groupBy("product_id", F.trunc("date", "MM").alias("month")).agg(F.sum("units").alias("units"))
    span = sums.groupBy("product_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = span.select("product_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return months.join(sums, ["product_id", "month"], "left").select("product_id", "month", F.coalesce("units", F.lit(0.0)).alias("units"))


def monthly_forecast(series: DataFrame, horizon: int = 12) -> DataFrame:
    """(product_id, month, units, is_forecast): linear trend of the last year times a month-of-year ratio.

    The last, unfinished month is left out of the base and forecast again.
    """
    whole = Window.partitionBy("product_id")
    rows = monthly(series).withColumns({"i": F.row_number().over(whole.orderBy("month")) - 1, "all": F.count("*").over(whole)})
    base = rows.filter((F.col("i") < F.col("all") - 1) | (F.col("all") == 1)).withColumn("n", F.count("*").over(whole))
    late = F.col("i") >= F.col("n") - 12
    x, y = F.when(late, F.col("i").cast("double")), F.when(late, F.col("units"))
    line = base.groupBy("product_id").agg(slope(y, x).alias("slope"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.max("n").alias("n"), F.max("month").alias("last"))
    line = line.withColumn("start", F.col("my") - F.col("slope") * F.col("mx"))
    trend = lambda i: F.greatest(F.lit(0.0), F.col("start") + F.col("slope") * i)
    ratios = base.join(line.select("product_id", "slope", "start"), "product_id").withColumn("t", trend(F.col("i"))).filter((F.col("t") > 0) & (F.col("units") > 0))
    ratios = ratios.groupBy("product_id", F.month("month").alias("moy")).agg(F.avg(F.col("units") / F.col("t")).alias("ratio"))
    grid = line.select("product_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("moy")).join(ratios, ["product_id", "moy"], "left")
    grid = grid.withColumn("ratio", F.coalesce("ratio", F.lit(1.0))).withColumn("ratio", F.col("ratio") / F.avg("ratio").over(whole))
    ahead = line.select("product_id", "slope", "start", "n", "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    ahead = ahead.withColumn("month", F.add_months("last", F.col("h"))).withColumn("moy", F.month("month")).join(grid, ["product_id", "moy"])
    value = F.greatest(F.lit(0.0), F.floor(trend(F.col("n") - 1 + F.col("h")) * F.col("ratio") + 0.5).cast("double"))
    future = ahead.select("product_id", "month", value.alias("units"), F.lit(True).alias("is_forecast"))
    past = base.select("product_id", "month", F.floor(F.col("units") + 0.5).cast("double").alias("units"), F.lit(False).alias("is_forecast"))
    return past.unionByName(future)


FACTORS = ("pm2_5", "temp_mean", "precip")


def env_drivers(months: DataFrame, env_months: DataFrame, factors: tuple[str, ...] = FACTORS) -> DataFrame:
    """(product_id, factor, corr, strength): monthly units against each weather factor, where all its months are known."""
    pairs = months.filter(~F.col("is_forecast")).join(F.broadcast(env_months), "month")
    long = pairs.select("product_id", "units", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("v")) for f in factors])).alias("z")).select("product_id", "units", "z.factor", "z.v")
    out = long.groupBy("product_id", "factor").agg(F.count("*").alias("n"), F.count("v").alias("known"), rounded(correlation(F.col("units"), F.col("v")), 2).alias("corr"))
    return out.filter((F.col("n") >= 4) & (F.col("known") == F.col("n"))).select("product_id", "factor", "corr", strength(F.col("corr")).alias("strength"))


def why_this_month(months: DataFrame, drivers: DataFrame) -> DataFrame:
    """(product_id, month, units, diff_pct, top_factor): the last month against the mean of up to twelve before it."""
    w = Window.partitionBy("product_id").orderBy("month")
    rows = months.filter(~F.col("is_forecast")).withColumns({"avg": F.avg("units").over(w.rowsBetween(-12, -1)), "n": F.row_number().over(w), "all": F.count("*").over(Window.partitionBy("product_id"))})
    last = rows.filter((F.col("n") == F.col("all")) & (F.col("all") >= 4) & (F.col("avg") > 0))
    top = drivers.filter(F.abs("corr") >= 0.35).groupBy("product_id").agg(F.max_by("factor", F.struct(F.abs("corr"), "factor")).alias("top_factor"))
    return last.join(top, "product_id", "left").select("product_id", "month", "units", F.floor((F.col("units") - F.col("avg")) / F.col("avg") * 100 + 0.5).cast("double").alias("diff_pct"), "top_factor")


def _review_weeks(demand: DataFrame, mood: DataFrame) -> DataFrame:
    """(product_id, t0, week, units, volume, net, rating): dense weeks of products with enough reviews, from both inputs' first day."""
    total = mood.groupBy("product_id").agg(F.sum("n").alias("reviews"), F.min("date").alias("m0")).filter(F.col("reviews") >= 12)
    start = demand.groupBy("product_id").agg(F.min("date").alias("d0")).join(total, "product_id").select("product_id", F.least("d0", "m0").alias("t0"))
    week = F.floor(F.datediff("date", "t0") / 7).cast("int").alias("week")
    units = demand.join(start, "product_id").groupBy("product_id", week).agg(F.sum("units").alias("units"))
    said = mood.join(start, "product_id").groupBy("product_id", week).agg(F.sum("n").cast("double").alias("volume"), F.avg("net").alias("net"), F.avg("avg_rating").alias("rating"))
    both = units.join(said, ["product_id", "week"], "full_outer")
    span = both.groupBy("product_id").agg(F.min("week").alias("lo"), F.max("week").alias("hi")).filter(F.col("hi") - F.col("lo") + 1 >= 8).join(start, "product_id")
    grid = span.select("product_id", "t0", F.explode(F.sequence("lo", "hi")).alias("week"))
    return grid.join(both, ["product_id", "week"], "left").fillna(0.0, ["units", "volume", "net", "rating"])


def sentiment_series(demand: DataFrame, mood: DataFrame) -> DataFrame:
    """(product_id, week_start, units_z, reviews_z, net_z): the weeks behind ``sentiment_signals``, standardised (0 where a series is flat)."""
    whole = Window.partitionBy("product_id")
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(whole), F.nullif(F.stddev_pop(c).over(whole), F.lit(0.0))), F.lit(0.0))
    rows = _review_weeks(demand, mood)
    return rows.select("product_id", F.expr("date_add(t0, week * 7)").alias("week_start"), rounded(z("units"), 3).alias("units_z"), rounded(z("volume"), 3).alias("reviews_z"), rounded(z("net"), 3).alias("net_z"))


def sentiment_signals(demand: DataFrame, mood: DataFrame, max_lag: int = 4) -> DataFrame:
    """(product_id, signal, best_lag_weeks, corr, strength): how reviews lead sales, over lags of 0 to ``max_lag`` weeks.

    ``mood`` has (product_id, date, n, avg_rating, net).
    """
    grid = _review_weeks(demand, mood)
    w = Window.partitionBy("product_id").orderBy("week")
    lagged = grid.withColumns({f"u{k}": F.lead("units", k).over(w) for k in range(max_lag + 1)})
    long = lagged.select("product_id", F.explode(F.array(*[F.struct(F.lit(name).alias("signal"), F.col(c).alias("s")) for name, c in (("review_volume", "volume"), ("net_sentiment", "net"), ("avg_rating", "rating"))])).alias("z"), *[f"u{k}" for k in range(max_lag + 1)])
    long = long.select("product_id", "z.signal", "z.s", *[f"u{k}" for k in range(max_lag + 1)])
    each = long.groupBy("product_id", "signal").agg(*[rounded(correlation(F.col("s"), F.col(f"u{k}")), 2).alias(f"c{k}") for k in range(max_lag + 1)])
    best = F.array_max(F.array(*[F.struct(F.abs(f"c{k}").alias("a"), F.lit(-k).alias("k"), F.col(f"c{k}").alias("c")) for k in range(max_lag + 1)]))
    out = each.withColumn("best", best)
    return out.select("product_id", "signal", F.when(F.col("best.a") > 0, -F.col("best.k")).otherwise(0).alias("best_lag_weeks"), F.col("best.c").alias("corr"), strength(F.col("best.c")).alias("strength"))
