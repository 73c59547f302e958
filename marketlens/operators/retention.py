"""Customer retention from orders and their items.

``orders`` has (order_sn, buyer, order_status, create_date, brand_id) and ``items`` (order_sn, price, quantity).
Only completed orders of a named buyer count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numeric import percent, rounded
from marketlens.sources.tables import global_percent_rank


def done(orders: DataFrame) -> DataFrame:
    return orders.filter((F.col("order_status") == "COMPLETED") & F.col("buyer").isNotNull() & (F.col("buyer").cast("string") != ""))


def buyer_base(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each buyer with paid items: orders, spend, first, last, brands, recency (days before the newest order).

    Items are summed by order before the join; every other table here comes from this one.
    """
    paid = items.groupBy("order_sn").agg(F.sum(F.col("price") * F.col("quantity")).alias("spend"))
    complete = done(orders)
    newest = complete.agg(F.max("create_date").alias("today"))
    base = complete.join(paid, "order_sn").groupBy("buyer").agg(
        F.count_distinct("order_sn").alias("orders"), F.sum("spend").alias("spend"), F.min("create_date").alias("first_order"), F.max("create_date").alias("last_order"), F.concat_ws(", ", F.array_sort(F.collect_set("brand_id"))).alias("brands")
    )
    return base.crossJoin(F.broadcast(newest)).withColumn("recency", F.datediff("today", "last_order")).drop("today")


#: Segments in the order in which they are tried: name, condition on frequency and recency.
# The order counts and days that part the segments.
def segment(freq: Column, recency: Column) -> Column:
    return (
        F.when((freq >= 3) & (recency <= 90), "champion")
        .when((freq >= 2) & (recency <= 180), "loyal")
        .when((freq == 1) & (recency <= 90), "new")
        .when((freq == 1) & (recency <= 180), "promising")
        .when((freq >= 3) & (recency > 365), "cannot_lose")
        .when((freq >= 2) & (recency <= 365), "at_risk")
        .when(recency <= 365, "hibernating")
        .otherwise("lost")
    )


def rfm_segments(base: DataFrame) -> DataFrame:
    money = F.col("spend").cast("double")
    return base.groupBy(segment(F.col("orders"), F.col("recency")).alias("segment")).agg(
        F.count("*").alias("customers"), rounded(F.avg("recency")).alias("avg_recency"), rounded(F.avg("orders"), 2).alias("avg_frequency"), rounded(F.sum("spend").cast("double") / F.count("*")).alias("avg_monetary"), rounded(F.sum("spend")).alias("total_spend")
    )


def retention_summary(orders: DataFrame) -> DataFrame:
    """By brand and for all: customers, repeat and one-time customers, orders, repeat rate, mean orders."""
    complete = done(orders)
    by_brand = complete.filter("brand_id is not null").groupBy(F.col("brand_id").alias("scope"), "buyer").agg(F.count("*").alias("o"))
    every = complete.groupBy(F.lit("ALL").alias("scope"), "buyer").agg(F.count("*").alias("o"))
    repeat = F.count_if(F.col("o") >= 2)
    return by_brand.unionByName(every).groupBy("scope").agg(
        F.count("*").alias("customers"), repeat.alias("repeat_customers"), F.count_if(F.col("o") == 1).alias("one_time"), F.sum("o").alias("total_orders"), percent(repeat, F.count("*")).alias("repeat_rate"), rounded(F.avg("o"), 2).alias("avg_orders")
    )


def _months(orders: DataFrame) -> DataFrame:
    """(buyer, month, n, first): active months with their orders; one small row each, so distinct buyers are plain counts.

    In place of orders it takes the months of ``buyer_state``.
    """
    if "month" in orders.columns:
        monthly = orders.select("buyer", "month", "n")
    else:
        monthly = done(orders).groupBy("buyer", F.trunc("create_date", "MM").alias("month")).agg(F.count("*").alias("n"))
    return monthly.withColumn("first", F.min("month").over(Window.partitionBy("buyer")))


def retention_monthly(orders: DataFrame) -> DataFrame:
    fresh = F.col("month") == F.col("first")
    return _months(orders).groupBy("month").agg(F.count_if(fresh).alias("new_customers"), F.count_if(~fresh).alias("returning_customers"), F.sum("n").alias("orders"))


def cohort_matrix(orders: DataFrame, as_of: str, months: int = 17, horizon: int = 12) -> DataFrame:
    """(cohort, months_since, customers, percent_of_first)."""
    since = F.months_between("month", "first").cast("int")
    start = F.trunc(F.add_months(F.lit(as_of).cast("date"), -months), "MM")
    rows = _months(orders).filter(F.col("first") >= start).withColumn("months_since", since).filter(F.col("months_since").between(0, horizon))
    counts = rows.groupBy(F.col("first").alias("cohort"), "months_since").agg(F.count("*").alias("customers"))
    size = F.max(F.when(F.col("months_since") == 0, F.col("customers"))).over(Window.partitionBy("cohort"))
    return counts.withColumn("percent_of_first", percent(F.col("customers"), size, 0))


def order_distribution(orders: DataFrame) -> DataFrame:
    per = done(orders).groupBy("buyer").agg(F.count("*").alias("o"))
    return per.groupBy(F.when(F.col("o") >= 5, "5+").otherwise(F.col("o").cast("string")).alias("bucket")).agg(F.count("*").alias("customers"))


def top_customers(base: DataFrame, k: int = 100) -> DataFrame:
    top = base.orderBy(F.desc("orders"), F.desc("spend"), "buyer").limit(k)
    return top.select("buyer", "orders", rounded(F.col("spend")).alias("spend"), "first_order", "last_order", "brands")


def at_risk(base: DataFrame, lo: int = 120, hi: int = 540, k: int = 100) -> DataFrame:
    """Repeat customers gone quiet, the biggest spenders first."""
    quiet = base.filter((F.col("orders") >= 2) & F.col("recency").between(lo, hi)).withColumn("spend", rounded(F.col("spend")))
    return quiet.orderBy(F.desc("spend"), "buyer").limit(k).select("buyer", "orders", "spend", "last_order", F.col("recency").alias("days_since"), "brands")


def purchase_gaps(orders: DataFrame) -> DataFrame:
    """(buyer, rn, gap): days from each order to the buyer's next one."""
    w = Window.partitionBy("buyer").orderBy("create_date", "order_sn")
    rows = done(orders).select("buyer", F.row_number().over(w).alias("rn"), F.datediff(F.lead("create_date").over(w), "create_date").alias("gap"))
    return rows.filter("gap is not null")


def gap_histogram(gaps: DataFrame) -> DataFrame:
    g = F.col("gap")
    bucket = F.when(g <= 30, "0-30").when(g <= 60, "31-60").when(g <= 90, "61-90").when(g <= 180, "91-180").when(g <= 365, "181-365").otherwise("365+")
    return gaps.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def retention_kpi(gaps: DataFrame, base: DataFrame) -> DataFrame:
    """Median and mean days to the second order, repeat buyers, share of revenue from repeat buyers, revenue."""
    second = gaps.filter("rn = 1").agg(F.expr("percentile_disc(0.5) within group (order by gap)").cast("int").alias("median_days_to_2nd"), rounded(F.avg("gap")).alias("avg_days_to_2nd"), F.count("*").alias("repeat2"))
    again = F.sum(F.when(F.col("orders") >= 2, F.col("spend")).otherwise(0))
    money = base.agg(percent(again, F.sum("spend")).alias("returning_rev_pct"), rounded(F.sum("spend")).alias("total_revenue"))
    return second.crossJoin(money)


def brand_mix(orders: DataFrame) -> DataFrame:
    per = done(orders).filter("brand_id is not null").select("buyer", "brand_id").distinct().groupBy("buyer").agg(F.count("*").alias("nb"))
    bucket = F.when(F.col("nb") <= 1, "1").when(F.col("nb") == 2, "2").otherwise("3+")
    return per.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("customers"))


def review_retention(orders: DataFrame, comments: DataFrame) -> DataFrame:
    """Repeat rates by the buyer's worst review."""
    buyers = done(orders).groupBy("buyer").agg(F.count_distinct("order_sn").alias("freq"))
    said = comments.filter((F.col("comment") != "") & F.col("buyer").isNotNull()).groupBy("buyer").agg(F.min("rating").alias("worst"), F.lit(True).alias("reviewed"))
    group = F.when(F.col("reviewed").isNull(), "none").when(F.col("worst") <= 2, "bad").when(F.col("worst") == 3, "middle").otherwise("good")
    return buyers.join(said, "buyer", "left").groupBy(group.alias("grp")).agg(F.count("*").alias("customers"), percent(F.count_if(F.col("freq") >= 2), F.count("*")).alias("repeat_rate"))


def pareto(base: DataFrame, cuts: tuple[float, ...] = (0.01, 0.05, 0.10, 0.20)) -> DataFrame:
    """Shares of revenue of the top buyers by percent rank."""
    ranked = global_percent_rank(base.select("buyer", "spend"), "spend")
    shares = [percent(F.sum(F.when(F.col("percent_rank") < c, F.col("spend")).otherwise(0)), F.sum("spend")).alias(f"top{round(c * 100)}") for c in cuts]
    return ranked.agg(*shares)


def derived_kpis(orders: DataFrame, base: DataFrame) -> DataFrame:
    """(metric, value): the repeat ladder, churn and core customers, and the value of winning the quiet ones back."""
    per = done(orders).groupBy("buyer").agg(F.count("*").alias("o"))
    ladder = [percent(F.count_if(F.col("o") >= k + 1), F.count_if(F.col("o") >= k)).alias(f"ladder_{k}_{k + 1}") for k in range(1, 5)]
    seg = base.withColumn("segment", segment(F.col("orders"), F.col("recency")))
    gone = F.count_if(F.col("segment").isin("lost", "cannot_lose"))
    rest = [percent(gone, F.count("*")).alias("churn_pct"), F.count_if(F.col("segment").isin("champion", "loyal")).cast("double").alias("core_customers"), rounded(F.sum(F.when(F.col("segment").isin("at_risk", "cannot_lose"), F.col("spend")).otherwise(0))).alias("win_back_value")]
    one = per.agg(*ladder).crossJoin(seg.agg(*rest))
    return one.unpivot([], one.columns, "metric", "value")


def reviewer_gap(review: DataFrame) -> DataFrame:
    """(reviewer_rate, other_rate, gap): repeat rates of customers who reviewed and of those who never did, from ``review_retention``."""
    said = F.col("grp") != "none"
    rate = rounded(F.try_divide(F.sum(F.when(said, F.col("repeat_rate") * F.col("customers"))), F.sum(F.when(said, F.col("customers")))), 1)
    out = review.agg(F.coalesce(rate, F.lit(0.0)).alias("reviewer_rate"), F.max(F.when(~said, F.col("repeat_rate"))).alias("other_rate"))
    return out.withColumn("gap", rounded(F.col("reviewer_rate") - F.col("other_rate"), 1))


def loyalty_rank(summary: DataFrame) -> DataFrame:
    """Brands by repeat rate, the most loyal first; one row a brand."""
    brands = summary.filter("scope <> 'ALL'")
    return brands.select("scope", "customers", "repeat_rate", F.row_number().over(Window.orderBy(F.desc("repeat_rate"), "scope")).alias("rank"))


def value_by_segment(segments: DataFrame) -> DataFrame:
    """(segment, total_spend, of_largest, of_all): what each segment of ``rfm_segments`` is worth, in percent of the largest and of all."""
    every = segments.agg(F.greatest(F.max("total_spend"), F.lit(1.0)).alias("_max"), F.sum("total_spend").alias("_sum"))  # one row
    rows = segments.crossJoin(F.broadcast(every))
    return rows.select("segment", "total_spend", percent(F.col("total_spend"), F.col("_max")).alias("of_largest"), percent(F.col("total_spend"), F.col("_sum")).alias("of_all"))


def brand_scope(summary: DataFrame, top: DataFrame, quiet: DataFrame) -> DataFrame:
    """By brand: its summary row, and of the lists of top and quiet customers those who bought of it, with the quiet ones' value.

    ``top`` and ``quiet`` are the bounded lists of ``top_customers`` and ``at_risk``.
    """

    def of(customers: DataFrame, name: str, *more: Column) -> DataFrame:
        rows = customers.withColumn("scope", F.explode(F.split("brands", ", ")))
        return rows.groupBy("scope").agg(F.count("*").alias(name), *more)

    out = summary.filter("scope <> 'ALL'").select("scope", "customers", "repeat_rate")
    out = out.join(of(top, "vips"), "scope", "left").join(of(quiet, "at_risk", F.sum("spend").alias("win_back_value")), "scope", "left")
    return out.fillna(0, ["vips", "at_risk"]).fillna(0.0, ["win_back_value"])
