"""Stand-ins: the inputs of the jobs, cut from the driver's order and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.numeric import rounded
from marketlens.functions.rules import Lexicon

#: Word lists that occur in the stand-in texts.
LEXICON = Lexicon(
    positive=["blewh", "stst", "eauou", "keitver", "lañ", "onthsh"],
    negative=["ndnd", "hewh", "ungung", "ouê", "osdo", "worthless", "the ed"],
    negation="of ",
    categories={"delivery": ["ouing", "keitbe", "queelle", "daez"], "quality": ["thst", "leaux", "schtz", "misós"], "price": ["license", "edwh", "enpf", "paou"]},
    danger=["stupid", "password", "arara"],
    warning=["trash", "rights reserved"],
    known=["delivery", "quality", "price", "other", "praise"],
    other="other",
    praise="praise",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_sn, buyer, order_status, create_date, brand_id)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    brands = lines.groupBy(F.col("l_orderkey").alias("order_sn")).agg(F.min("p_brand").alias("brand_id"))
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_sn"), F.col("o_custkey").alias("buyer"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("OPEN").alias("order_status"), F.col("o_orderdate").cast("date").alias("create_date")
    )
    return base.join(brands, "order_sn", "left")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_sn, price, quantity)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_sn"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("int").alias("quantity"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, platform, brand, product_id, product_name, units, gmv), 24 years later than shipped."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.add_months(F.col("l_shipdate").cast("date"), 288).alias("date"), F.col("l_returnflag").alias("platform"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("l_quantity").cast("decimal(18,2)").alias("units"), F.col("l_extendedprice").cast("decimal(18,2)").alias("gmv"),
    )


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, net_sales)."""
    return table(spark, sf_dir, "orders").select(F.add_months(F.col("o_orderdate").cast("date"), 288).alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("net_sales"))


def brand_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, date, units, gmv): daily sales with brands as the products, a dense grain."""
    daily = sales(spark, sf_dir).groupBy(F.col("brand").alias("product_id"), "date")
    return daily.agg(F.sum("units").cast("double").alias("units"), F.sum("gmv").cast("double").alias("gmv"))


def brand_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, stock) of brands; some have none on record."""
    size, n = F.sum(F.col("p_size").cast("long")), F.count("*")
    stock = F.when(n % 7 == 0, None).otherwise((size * 3) % 2500).cast("double")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("product_id")).agg(stock.alias("stock"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(comment_id, created_at, username, buyer, brand, product_name, rating, comment, images, shop_id, status): whole texts, of all documents."""
    docs, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    rows = docs.join(events, F.col("doc_id") == F.col("event_id"), "left")
    k = F.col("doc_id")
    return rows.select(
        k.alias("comment_id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("username"), k.alias("buyer"), F.when(k % 17 == 0, None).otherwise(F.col("source")).alias("brand"),
        F.when(k % 29 == 0, None).otherwise((k % 50).cast("string")).alias("product_name"), F.when(k % 11 == 0, None).otherwise(1 + (k * 7) % 5).cast("double").alias("rating"), F.col("text").alias("comment"),
        F.when(k % 3 == 0, F.array(F.lit("a.jpg"))).otherwise(F.array().cast("array<string>")).alias("images"),
        F.when(k % 4 == 0, F.lit("shop")).otherwise((k % 9).cast("string")).alias("shop_id"), F.element_at(F.array(F.lit("new"), F.lit("in_progress"), F.lit("resolved")), (k % 3 + 1).cast("int")).alias("status"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, item_name, brand, price, thumbnail_url, image_url)."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("item_id"), F.col("p_name").alias("item_name"), F.when(k % 5 == 0, None).otherwise(F.col("p_brand")).alias("brand"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("t"), k.cast("string"))).alias("thumbnail_url"), F.concat(F.lit("i"), k.cast("string")).alias("image_url"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, partition_date, update_time, supplier, price): one item snapshot a line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item_id"), F.col("l_shipdate").cast("date").alias("partition_date"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("update_time"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(comment_id, agent, status, at, reply_text)."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "sent").when(kind == "error", "failed").otherwise(None)
    agent = F.when(F.col("user_id") % 8 == 0, None).when(F.col("user_id") % 8 == 1, "").otherwise(F.concat(F.lit("agent"), (F.col("user_id") % 8).cast("string")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("comment_id"), agent.alias("agent"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("Thanks for "), kind).alias("reply_text"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, avatar) of agents; some have no picture, and a name can come twice."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("agent"), (key % 9).cast("string")).alias("name"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lower("n_name"), F.lit(".png"))).alias("avatar"))


def part_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, stock) of parts; some have none on record."""
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 5 == 0, None).otherwise(size * 3).alias("stock"))


def platform_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, platform, stock) of parts on up to three platforms; some parts are on none."""
    key = F.col("p_partkey")
    on = F.array(F.when(key % 2 == 0, F.lit("A")), F.when(key % 3 > 0, F.lit("N")), F.when(key % 5 == 1, F.lit("R")))
    rows = table(spark, sf_dir, "part").select(key.alias("product_id"), "p_size", F.explode(F.array_compact(on)).alias("platform"))
    return rows.select("product_id", "platform", (F.col("p_size") * F.when(F.col("platform") == "A", 1).when(F.col("platform") == "N", 2).otherwise(4)).cast("double").alias("stock"))


def stock_history(dense: DataFrame) -> DataFrame:
    """(product_id, date, stock): every fourth day out of stock, none on record for some days."""
    day = F.dayofyear("date")
    return dense.select("product_id", "date", F.when(day % 11 == 0, None).when(day % 4 == 0, 0.0).otherwise((day % 4).cast("double")).alias("stock"))


def raw_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments as a shop's own table might hold them: other names, epoch seconds, stars as text, empty pictures."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "events"), k == F.col("event_id"), "left")
    star = F.when(k % 7 == 0, "NaN").when(k % 5 == 0, "bad").otherwise((1 + k % 5).cast("string"))
    return rows.select(
        F.when(k % 13 == 0, "").otherwise(k.cast("string")).alias("id"), F.col("source").alias("shop"), star.alias("stars"), F.col("text").alias("body"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("made"),
        F.when(k % 3 == 0, F.lit(0)).otherwise(F.lit(1700000000) + k).cast("long").alias("answered"), F.when(k % 4 == 0, "").otherwise("thanks").alias("answer"), F.array(F.lit("a.jpg"), F.lit(""), F.lit(None).cast("string")).alias("pics"),
    )


def env_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, pm2_5, temp_mean, precip): from order totals by day."""
    daily = financials(spark, sf_dir).groupBy("date").agg(F.sum("net_sales").cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    return daily.select("date", rounded(F.col("s") / F.col("n") / 1000, 1).alias("pm2_5"), (20 + F.col("n")).alias("temp_mean"), rounded(F.col("s") % 50, 1).alias("precip"))
