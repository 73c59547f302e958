"""The buyer base kept up by deltas of days, so that a day's orders are joined with their items once.

Two tables with a commit log lie under a path, both partitioned by month. ``days`` has a row for each buyer and day with
completed orders, and ``months`` a row for each buyer and month, merged from its days. All columns merge: counts and sums add, dates take the least or greatest, brands
unite; an order is of one day, so orders are never counted twice. A delta brings all orders of the days it names; their
rows are put in place of the old ones, and the months that they touch are written anew. So a repeated delta changes
nothing, a late or cancelled order is put right by its day's next delta, and a crash between the two tables is mended by a rerun.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators.retention import done
from marketlens.sources import commits


def day_state(orders: DataFrame, items: DataFrame) -> DataFrame:
    """(buyer, n, orders, spend, brands, day): completed orders, and of those with items their number, spend and brands."""
    paid = items.groupBy("order_sn").agg(F.sum(F.col("price") * F.col("quantity")).alias("spend"))
    rows, has = done(orders).join(paid, "order_sn", "left"), F.col("spend").isNotNull()
    return rows.groupBy("buyer", F.col("create_date").alias("day")).agg(
        F.count("*").alias("n"), F.count_distinct(F.when(has, F.col("order_sn"))).alias("orders"), F.sum("spend").cast("decimal(38,2)").alias("spend"), F.collect_set(F.when(has, F.col("brand_id"))).alias("brands")
    )


def _merged(rows: DataFrame, *by) -> DataFrame:
    brands = F.array_distinct(F.flatten(F.collect_list("brands")))  # a row a day or month, each with few brands
    return rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("orders").alias("orders"), F.sum("spend").cast("decimal(38,2)").alias("spend"), F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"), F.max("seen").alias("seen"), brands.alias("brands")
    )


def month_state(days: DataFrame) -> DataFrame:
    """(buyer, month, n, orders, spend, first_order, last_order, seen, brands); the dates are of orders with items, ``seen`` of any."""
    paid = F.when(F.col("orders") > 0, F.col("day"))
    return _merged(days.withColumns({"first_order": paid, "last_order": paid, "seen": F.col("day")}), "buyer", F.trunc("day", "MM").alias("month"))


def apply_delta(spark: SparkSession, path: str, orders: DataFrame, items: DataFrame, days: list[str]) -> None:
    """Take in all orders of ``days`` (a list, as text); rows of other days are left out."""
    touched, columns = {f"{d[:7]}-01" for d in days}, ["buyer", "n", "orders", "spend", "brands", "day", "month"]
    new = day_state(orders.filter(F.col("create_date").cast("string").isin(days)), items).withColumn("month", F.trunc("day", "MM")).select(*columns)
    other = lambda old: old.filter(~F.col("day").cast("string").isin(days)).unionByName(new)
    commits.write_partitions(spark, f"{path}/days", lambda old: new if old is None else other(old), "month", "buyer", touched)
    day_rows = commits.read(spark, f"{path}/days").filter(F.col("month").cast("string").isin(list(touched)))
    columns = ["buyer", "n", "orders", "spend", "first_order", "last_order", "seen", "brands", "month"]
    commits.write_partitions(spark, f"{path}/months", lambda old: month_state(day_rows).select(*columns), "month", "buyer", touched)


def months(spark: SparkSession, path: str) -> DataFrame:
    """What ``retention_monthly`` and ``cohort_matrix`` take in place of orders."""
    return commits.read(spark, f"{path}/months")


def base(months: DataFrame) -> DataFrame:
    """The rows of ``retention.buyer_base``, from a few rows a buyer."""
    newest = months.agg(F.max("seen").alias("today"))
    rows = _merged(months, "buyer").filter("orders > 0")
    rows = rows.crossJoin(F.broadcast(newest)).withColumn("recency", F.datediff("today", "last_order"))  # newest is one row
    return rows.select("buyer", "orders", "spend", "first_order", "last_order", F.concat_ws(", ", F.array_sort("brands")).alias("brands"), "recency")
