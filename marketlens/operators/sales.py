"""Sales by scope, product demand, catalog and stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import percent, rounded
from marketlens.sources.tables import latest


def gmv_scopes(sales: DataFrame, financials: DataFrame) -> DataFrame:
    """(scope, date, gmv, units, net_sales) for all, each platform and each brand, from one scan by grouping sets."""
    sets = sales.groupingSets([["date"], ["date", "platform"], ["date", "brand"]], "date", "platform", "brand")
    rows = sets.agg(F.sum("gmv").cast("double").alias("gmv"), F.sum("units").cast("double").alias("units"), F.grouping("platform").alias("gp"), F.grouping("brand").alias("gb"))
    scope = F.when((F.col("gp") == 1) & (F.col("gb") == 1), "ALL").when(F.col("gp") == 0, F.concat(F.lit("platform:"), "platform")).otherwise(F.concat(F.lit("brand:"), "brand"))
    rows = rows.select(scope.alias("scope"), "date", "gmv", "units").filter("scope is not null")
    net = financials.filter("date is not null").groupBy("date").agg(F.sum("net_sales").cast("double").alias("net")).withColumn("scope", F.lit("ALL"))
    return rows.join(net, ["scope", "date"], "left").withColumnRenamed("net", "net_sales")


def product_demand(sales: DataFrame, as_of: Column | None = None, active_days: int = 90, history_days: int = 540) -> DataFrame:
    """Daily demand of the products that sold in the last ``active_days``, over ``history_days``.

    ``as_of`` is a date; by default the newest date of the sales, found in one row.
    """
    if as_of is None:
        as_of = F.lit(sales.agg(F.max("date")).first()[0]).cast("date")
    sold = sales.filter(F.col("units") > 0)
    active = sold.filter((F.col("date") >= F.date_sub(as_of, active_days)) & F.col("product_id").isNotNull()).select("product_id").distinct()
    recent = sold.filter(F.col("date") >= F.date_sub(as_of, history_days)).join(active, "product_id", "left_semi")
    return recent.groupBy("product_id", "date").agg(
        F.max("product_name").alias("product_name"), F.max("brand").alias("brand"), F.max("platform").alias("platform"), F.sum("units").cast("double").alias("units"), F.sum("gmv").cast("double").alias("gmv")
    )


def product_catalog(demand: DataFrame, stock: DataFrame, as_of: Column) -> DataFrame:
    """One row for each product: 30 and 90 day rates and its stock (null where none is known).

    Where the demand has product_name, brand or platform, the product gets the earliest one that isn't empty. Of several
    stock rows of a product the one of its own platform counts, if both tables tell the platform, else the one of the last
    platform by name; of rows alike in that the greatest stock.
    """
    within = lambda n: F.sum(F.when(F.col("date") >= F.date_sub(as_of, n), F.col("units")).otherwise(0.0))
    named = [c for c in ("product_name", "brand", "platform") if c in demand.columns]
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("date", c)))
    rates = demand.groupBy("product_id").agg(within(30).alias("units_30"), within(90).alias("units_90"), *(first(c).alias(c) for c in named))
    held = stock.select("product_id", F.col("platform" if "platform" in stock.columns else "product_id").cast("string").alias("_at"), F.col("stock").alias("_s"))
    own = F.coalesce(F.col("_at") == F.col("platform"), F.lit(False)) if "platform" in named and "platform" in stock.columns else F.lit(False)
    chosen = rates.join(held, "product_id", "left").groupBy(*rates.columns)
    out = chosen.agg(F.max(F.struct(own.alias("own"), F.col("_at"), F.col("_s")))["_s"].alias("stock"))
    return out.select("product_id", *named, "units_30", "units_90", rounded(F.col("units_30") / 30, 3).alias("avg_daily_30"), rounded(F.col("units_90") / 90, 3).alias("avg_daily_90"), "stock")


def name_list(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-empty values of a column, in order."""
    return df.select(column).filter(F.coalesce(F.col(column), F.lit("")) != "").distinct().orderBy(column)


def stock_metrics(catalog: DataFrame, lead: int = 14, target: int = 30) -> DataFrame:
    """Daily rate, days of cover, status, reorder point and recommended quantity."""
    rate = F.when(F.col("avg_daily_30") > 0, F.col("avg_daily_30")).otherwise(F.coalesce("avg_daily_90", F.lit(0.0)))
    rows = catalog.withColumn("rate", rate)
    cover = F.when((F.col("rate") > 0) & F.col("stock").isNotNull(), F.floor(F.try_divide(F.col("stock"), F.col("rate")) + 0.5).cast("int"))
    rows = rows.withColumn("days_of_cover", cover)
    status = (
        F.when(F.col("stock").isNull(), "nostock")
        .when(F.col("rate") <= 0, F.when(F.col("stock") > 0, "dead").otherwise("nostock"))
        .when(F.col("days_of_cover") <= lead, "urgent")
        .when(F.col("days_of_cover") <= 2 * lead, "soon")
        .when(F.col("days_of_cover") >= 120, "overstock")
        .otherwise("ok")
    )
    reorder = F.ceil(F.col("rate") * lead + F.col("rate") * lead * 0.5).cast("int")
    quantity = F.greatest(F.lit(0), F.ceil(F.col("rate") * (lead + target) - F.coalesce("stock", F.lit(0.0)))).cast("int")
    return rows.select("product_id", rounded(F.col("rate"), 2).alias("daily_rate"), "days_of_cover", status.alias("status"), reorder.alias("reorder_point"), quantity.alias("recommended_qty"))


#: Statuses from the most pressing.
PRESSING = ["urgent", "soon", "ok", "overstock", "dead", "nostock"]


def browse_catalog(catalog: DataFrame, metrics: DataFrame, q: str = "", brand: str | None = None, status: str | None = None, limit: int = 3000) -> DataFrame:
    """Catalog rows with their stock status, filtered by brand, a search in name, brand or id, and status.

    Pressing statuses come first, then what sold most in 90 days; at most ``limit`` rows. ``catalog`` may have name and
    brand columns.
    """
    named = catalog.withColumns({c: F.lit(None).cast("string") for c in ("name", "brand") if c not in catalog.columns})
    rows = named.join(metrics.select("product_id", "status", "days_of_cover", "recommended_qty"), "product_id", "left")
    if brand:
        rows = rows.filter(F.col("brand") == brand)
    if q:
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "name", "brand", F.col("product_id").cast("string"))), F.lit(q.lower())))
    if status:
        rows = rows.filter(F.col("status") == status)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRESSING)), F.col("status")), F.lit(len(PRESSING) + 1))
    return rows.orderBy(rank, F.desc_nulls_last("units_90"), "product_id").limit(limit)


def stock_status_counts(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("status").agg(F.count("*").alias("products"))


def latest_items(snapshots: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The newest snapshot of each item, of those in ``ids`` where given."""
    rows = snapshots if ids is None else snapshots.join(ids, "item_id", "left_semi")
    return latest(rows, ["item_id"], ["partition_date", "update_time"])


def latest_stock(catalog: DataFrame, skus: DataFrame) -> DataFrame:
    """(product_id, platform, stock, reserved, name, brand) from each source's newest partition.

    ``catalog`` has (item_id, item_name, brand, model_stock, model_reserved, partition_date) and ``skus``
    (product_id, quantity, fetched_date).
    """

    def newest(df: DataFrame, column: str) -> DataFrame:
        last = df.agg(F.max(column).alias("_last"))  # one row
        return df.join(F.broadcast(last), F.col(column) == F.col("_last"), "left_semi")

    one = newest(catalog, "partition_date").filter("item_id is not null").groupBy(F.col("item_id").cast("string").alias("product_id")).agg(
        F.lit("shopee").alias("platform"), F.sum("model_stock").cast("long").alias("stock"), F.sum("model_reserved").cast("long").alias("reserved"), F.max("item_name").alias("name"), F.max("brand").alias("brand")
    )
    two = newest(skus, "fetched_date").filter("product_id is not null").groupBy(F.col("product_id").cast("string").alias("product_id")).agg(
        F.lit("tiktok_shop").alias("platform"), F.sum("quantity").cast("long").alias("stock"), F.lit(0).cast("long").alias("reserved"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("brand")
    )
    return one.unionByName(two)


def stock_snapshot(stock: DataFrame, day: str) -> DataFrame:
    """Today's stock by product, to be upserted into the history by (product_id, date)."""
    return stock.groupBy("product_id").agg(F.sum("stock").alias("stock"), F.sum("reserved").alias("reserved")).withColumn("date", F.lit(day).cast("date"))


def average_price(demand: DataFrame, rows: int = 90) -> DataFrame:
    """gmv / units over each product's last ``rows`` rows, over all of them where those sold nothing."""
    from pyspark.sql import Window

    late = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("date"))) <= rows
    marked = demand.withColumn("late", late)
    u, g = F.sum(F.when(F.col("late"), F.col("units")).otherwise(0.0)), F.sum(F.when(F.col("late"), F.col("gmv")).otherwise(0.0))
    price = F.coalesce(F.when(u > 0, F.try_divide(g, u)), F.try_divide(F.sum("gmv"), F.sum("units")), F.lit(0.0))
    return marked.groupBy("product_id").agg(rounded(price, 4).alias("unit_price"))


def merge_environment(archive: DataFrame, forecast: DataFrame, air: DataFrame) -> DataFrame:
    """Weather by day: the archive wins, the forecast fills its nulls, hourly particulates become daily means (1 dp).

    ``archive`` and ``forecast`` are landed JSON rows with daily{time[], temperature_2m_mean[], precipitation_sum[]};
    ``air`` has hourly{time[], pm2_5[]}.
    """

    def days(df: DataFrame, tag: str) -> DataFrame:
        z = F.explode(F.arrays_zip(F.col("daily.time").alias("time"), F.col("daily.temperature_2m_mean").alias("t"), F.col("daily.precipitation_sum").alias("p"))).alias("z")
        return df.select(z).select(F.col("z.time").cast("date").alias("date"), F.col("z.t").alias(f"t_{tag}"), F.col("z.p").alias(f"p_{tag}"))

    hours = air.select(F.explode(F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.pm2_5").alias("v"))).alias("z"))
    pm = hours.groupBy(F.to_date(F.substring("z.time", 1, 10)).alias("date")).agg(rounded(F.avg("z.v"), 1).alias("pm2_5"))
    both = days(archive, "a").join(days(forecast, "f"), "date", "full_outer").join(pm, "date", "full_outer")
    return both.select("date", "pm2_5", F.coalesce("t_a", "t_f").alias("temp_mean"), F.coalesce("p_a", "p_f").alias("precip"))


def env_monthly(env: DataFrame) -> DataFrame:
    return env.groupBy(F.trunc("date", "MM").alias("month")).agg(rounded(F.avg("pm2_5"), 1).alias("pm2_5"), rounded(F.avg("temp_mean"), 1).alias("temp_mean"), rounded(F.sum("precip"), 1).alias("precip"))


def scope_lists(gmv: DataFrame) -> DataFrame:
    """(kind, name) of the scopes on record."""
    parts = F.split("scope", ":", 2)
    return gmv.select("scope").distinct().select(F.when(F.col("scope") == "ALL", "all").otherwise(parts[0]).alias("kind"), F.when(F.col("scope") == "ALL", "ALL").otherwise(F.get(parts, F.lit(1))).alias("name"))


def year_over_year(daily: DataFrame) -> DataFrame:
    """(key, date, gmv, gmv_before): each day beside the day 365 days earlier, by an equi-join."""
    before = daily.select("scope", F.date_add("date", 365).alias("date"), F.col("gmv").alias("gmv_before"))
    return daily.select("scope", "date", "gmv").join(before, ["scope", "date"]).withColumn("change_pct", percent(F.col("gmv") - F.col("gmv_before"), F.col("gmv_before")))
