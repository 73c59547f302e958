"""Roll-ups of labelled comments: (comment_id, created_at, brand, product_name, rating, sentiment, category, severity, urgent, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numeric import js_round, percent, rounded, score
from marketlens.functions.rules import direction
from marketlens.sources.scratch import written

NO_PRODUCT, NO_BRAND = "(ไม่ระบุสินค้า)", "ไม่ระบุแบรนด์"


def _n(mood: str) -> Column:
    return F.count_if(F.col("sentiment") == mood)


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), _n("positive").alias("positive"), _n("neutral").alias("neutral"), _n("negative").alias("negative"), rounded(F.avg("rating"), 2).alias("avg_rating"), F.count_if("urgent").alias("urgent_count"), score(_n("positive"), _n("negative"), F.count("*")).alias("sentiment_score")]


def product_stats(comments: DataFrame, products: DataFrame) -> DataFrame:
    """One row for each product: aggregated first, then joined with the product's facts."""
    stats = comments.groupBy(F.coalesce("product_name", F.lit(NO_PRODUCT)).alias("product_name")).agg(*_counts(), F.max("brand").alias("seen"))
    facts = products.select(F.col("item_id").alias("product_name"), "item_name", "price", F.col("brand").alias("own"))
    return stats.join(facts, "product_name", "left").withColumn("brand", F.coalesce("own", "seen")).drop("own", "seen")


def brand_stats(comments: DataFrame) -> DataFrame:
    return comments.groupBy(F.coalesce("brand", F.lit(NO_BRAND)).alias("brand")).agg(*_counts())


def listed(stats: DataFrame, kind: str, worst_first: bool = True, limit: int = 500) -> DataFrame:
    """The order of the lists: products (at most ``limit``) and brands by score, categories by their number of complaints."""
    if kind == "category":
        return stats.orderBy(F.desc("total"), "category")
    rows = stats.orderBy(F.asc("sentiment_score") if worst_first else F.desc("sentiment_score"), "product_name" if kind == "product" else "brand")
    return rows.limit(limit) if kind == "product" else rows


def category_stats(comments: DataFrame, praise: str) -> DataFrame:
    return comments.filter((F.col("sentiment") == "negative") & (F.col("category") != praise)).groupBy("category").agg(F.count("*").alias("total"))


def daily_trend(comments: DataFrame, zone: str = "Asia/Bangkok", by: str | None = None, praise: str | None = None) -> DataFrame:
    """By local date, and by brand or category where asked; by category only complaints count."""
    rows = comments.withColumn("date", F.to_date(F.from_utc_timestamp("created_at", zone)))
    if by == "category":
        rows = rows.filter((F.col("sentiment") == "negative") & (F.col("category") != praise))
        return rows.groupBy("date", "category").agg(F.count("*").alias("total"))
    if by == "brand":
        rows = rows.withColumn("brand", F.coalesce("brand", F.lit(NO_BRAND)))
    return rows.groupBy("date", *([by] if by else [])).agg(*_counts())


def product_sentiment_daily(comments: DataFrame) -> DataFrame:
    """By product and UTC date: counts, mean rating and net mood; what isn't positive or negative is neutral."""
    rows = comments.filter("product_name is not null").groupBy("product_name", F.to_date("created_at").alias("date"))
    n = F.count("*")
    return rows.agg(n.alias("n"), rounded(F.avg("rating"), 2).alias("avg_rating"), _n("positive").alias("pos"), _n("negative").alias("neg"), (n - _n("positive") - _n("negative")).alias("neu"), rounded((_n("positive") - _n("negative")) / n, 3).alias("net"))


def _window(comments: DataFrame, days: int, as_of: Column) -> DataFrame:
    return comments.filter(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))


def window_summary(comments: DataFrame, days: int, as_of: Column, other: str, praise: str) -> dict[str, DataFrame]:
    """The summary of the last ``days``: overall, brands (worst first by score), issues (top 8, brands' top 5) and urgent (top 100).

    Overall and brands come from one scan by grouping sets.
    """
    brand = F.coalesce(F.nullif(F.col("brand"), F.lit("")), F.lit(NO_BRAND))
    rows = _window(comments, days, as_of).withColumns({"brand_key": brand, "sentiment": F.coalesce("sentiment", F.lit("neutral")), "category": F.coalesce("category", F.lit(other))})
    stars = F.least(F.lit(5), F.greatest(F.lit(1), js_round(F.col("rating"))))
    rows = rows.withColumn("stars", stars)
    sets = rows.groupingSets([[], ["brand_key"]], "brand_key").agg(
        F.grouping("brand_key").alias("all"), *_counts(), *(F.count_if(F.col("stars") == k).alias(f"stars_{k}") for k in range(1, 6))
    )
    sets = sets.withColumns({"sentiment_score": F.coalesce("sentiment_score", F.lit(0.0))}).withColumn("direction", direction(F.col("sentiment_score")))
    complaint = rows.filter((F.col("sentiment") == "negative") & (F.col("category") != praise))

    def top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
        counts = df.groupBy(*keys, "category").agg(F.count("*").alias("count"))
        w = Window.partitionBy(*keys).orderBy(F.desc("count"), "category") if keys else None
        if w is None:  # few categories; TakeOrdered, no window
            return counts.orderBy(F.desc("count"), "category").limit(k)
        return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    return {
        "overall": sets.filter(F.col("all") == 1).drop("all", "brand_key"),
        "brands": sets.filter(F.col("all") == 0).drop("all").withColumnRenamed("brand_key", "brand"),
        "categories": top(rows, [], 8),
        "issues": top(complaint, [], 8),
        "brand_issues": top(complaint, ["brand_key"], 5),
        "urgent": rows.filter("urgent").orderBy(F.desc("severity"), "comment_id").limit(100),
    }


def brand_slice(summary_brands: DataFrame, brand: str) -> DataFrame:
    """A brand's row of a window summary with its rate of positive comments."""
    return summary_brands.filter(F.col("brand") == brand).withColumn("positive_rate", percent(F.col("positive"), F.col("total"), 0))


def period_compare(daily: DataFrame, days: int) -> DataFrame:
    """(period, total, urgent, score, pos_rate, avg_rating) of the last ``days`` on record and of as many before."""
    newest = daily.agg(F.max("date").alias("top"))
    rows = daily.crossJoin(F.broadcast(newest)).withColumn("back", F.datediff("top", "date"))
    period = F.when(F.col("back") < days, "current").when(F.col("back") < 2 * days, "previous")
    rows = rows.withColumn("period", period).filter("period is not null")
    total = F.sum("total")
    return rows.groupBy("period").agg(
        total.alias("total"), F.sum("urgent_count").alias("urgent"), percent(F.sum("positive") - F.sum("negative"), total).alias("score"), percent(F.sum("positive"), total, 0).alias("pos_rate"),
        rounded(F.try_divide(F.sum(F.coalesce("avg_rating", F.lit(0.0)) * F.col("total")), total), 2).alias("avg_rating"),
    )


def brand_movers(brand_daily: DataFrame, days: int, least: int = 10) -> DataFrame:
    """(brand, current, previous, change) of brands with at least ``least`` comments in both periods."""
    newest = brand_daily.agg(F.max("date").alias("top"))
    rows = brand_daily.crossJoin(F.broadcast(newest)).withColumn("back", F.datediff("top", "date")).filter(F.col("back") < 2 * days)

    def side(now: bool) -> tuple[Column, Column]:
        mine = (F.col("back") < days) if now else (F.col("back") >= days)
        n = F.sum(F.when(mine, F.col("total")).otherwise(0))
        return n, rounded(F.try_divide(F.sum(F.when(mine, F.col("sentiment_score") * F.col("total")).otherwise(0.0)), n), 1)

    (n1, s1), (n0, s0) = side(True), side(False)
    out = rows.groupBy("brand").agg(n1.alias("n1"), n0.alias("n0"), s1.alias("current"), s0.alias("previous")).filter((F.col("n1") >= least) & (F.col("n0") >= least))
    return out.select("brand", "current", "previous", rounded(F.col("current") - F.col("previous"), 1).alias("change"))


def trend_insights(daily: DataFrame, brand_daily: DataFrame, category_daily: DataFrame, products: DataFrame, days: int) -> DataFrame:
    """(kind, subject, value, before) of what is worth telling about the last ``days``."""
    periods = period_compare(daily, days)
    pair = periods.groupBy().agg(*(F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{c}_{p}") for p in ("current", "previous") for c in ("score", "total")))
    score_move = pair.select(F.lit("score").alias("kind"), F.lit(None).cast("string").alias("subject"), rounded(F.col("score_current") - F.col("score_previous"), 1).alias("value"), F.col("score_previous").alias("before")).filter(F.abs("value") >= 1)
    volume = pair.select(F.lit("volume").alias("kind"), F.lit(None).cast("string").alias("subject"), js_round(F.try_divide(F.col("total_current") - F.col("total_previous"), F.col("total_previous")) * 100).cast("double").alias("value"), F.col("total_previous").cast("double").alias("before")).filter(F.abs("value") >= 15)
    movers = brand_movers(brand_daily, days)
    worst = movers.orderBy("change", "brand").limit(1).filter(F.col("change") <= -3).select(F.lit("worst_brand").alias("kind"), F.col("brand").alias("subject"), F.col("change").alias("value"), F.col("previous").alias("before"))
    best = movers.orderBy(F.desc("change"), "brand").limit(1).filter(F.col("change") >= 3).select(F.lit("best_brand").alias("kind"), F.col("brand").alias("subject"), F.col("change").alias("value"), F.col("previous").alias("before"))
    newest = daily.agg(F.max("date").alias("top"))
    cats = category_daily.crossJoin(F.broadcast(newest)).withColumn("back", F.datediff("top", "date")).filter(F.col("back") < 2 * days)
    cats = cats.groupBy("category").agg(F.sum(F.when(F.col("back") < days, F.col("total")).otherwise(0)).alias("now"), F.sum(F.when(F.col("back") >= days, F.col("total")).otherwise(0)).alias("was")).filter("now > 0")
    rise = F.when(F.col("was") > 0, js_round(F.try_divide(F.col("now") - F.col("was"), F.col("was")) * 100)).otherwise(F.when(F.col("now") >= 5, 999).otherwise(0)).cast("double")
    rising = cats.filter("now >= 5").withColumn("value", rise).orderBy(F.desc("value"), "category").limit(1).filter("value >= 25").select(F.lit("rising_category").alias("kind"), F.col("category").alias("subject"), "value", F.col("was").cast("double").alias("before"))
    topmost = cats.orderBy(F.desc("now"), "category").limit(1).select(F.lit("top_category").alias("kind"), F.col("category").alias("subject"), F.col("now").cast("double").alias("value"), F.col("was").cast("double").alias("before"))
    alert = products.filter("total >= 3").orderBy(F.desc("urgent_count"), "sentiment_score", "product_name").limit(1).filter("urgent_count > 0 or sentiment_score < 0").select(F.lit("product").alias("kind"), F.col("product_name").alias("subject"), F.col("sentiment_score").alias("value"), F.col("urgent_count").cast("double").alias("before"))
    recent = daily.crossJoin(F.broadcast(newest)).filter(F.datediff("top", "date") < days)
    stats = recent.agg(F.avg("urgent_count").alias("m"), F.stddev_pop("urgent_count").alias("sd"), F.count("*").alias("n"))
    spike = recent.orderBy(F.desc("urgent_count"), "date").limit(1).crossJoin(F.broadcast(stats)).filter((F.col("n") >= 4) & (F.col("sd") > 0) & (F.col("urgent_count") > F.col("m") + 2 * F.col("sd")) & (F.col("urgent_count") >= 3)).select(F.lit("urgent_spike").alias("kind"), F.col("date").cast("string").alias("subject"), F.col("urgent_count").cast("double").alias("value"), rounded(F.col("m"), 2).alias("before"))
    full = recent.filter("total >= 3")
    ends = full.agg(F.max_by("date", F.struct("sentiment_score", -F.datediff("date", F.lit("1970-01-01")))).alias("b"), F.max("sentiment_score").alias("bs"), F.min_by("date", F.struct("sentiment_score", "date")).alias("w"), F.min("sentiment_score").alias("ws"), F.count("*").alias("n")).filter("n >= 2")
    days_ = ends.select(F.explode(F.array(F.struct(F.lit("best_day").alias("kind"), F.col("b").cast("string").alias("subject"), F.col("bs").alias("value"), F.lit(None).cast("double").alias("before")), F.struct(F.lit("worst_day").alias("kind"), F.col("w").cast("string").alias("subject"), F.col("ws").alias("value"), F.lit(None).cast("double").alias("before")))).alias("z")).select("z.*")
    out = score_move
    for part in (volume, worst, best, rising, topmost, alert, spike, days_):
        out = out.unionByName(part)
    return out


def pivot_top(daily: DataFrame, key: str, value: str, k: int, zero: bool = False) -> DataFrame:
    """Daily values of the ``k`` biggest keys, a column each; few keys, so their names come to the driver.

    The daily rows are written, as they are read for the names and again for the values.
    """
    daily = written(daily.select("date", *dict.fromkeys((key, value, "total"))), "days")
    tops = [r[0] for r in daily.groupBy(key).agg(F.sum("total").alias("n")).orderBy(F.desc("n"), key).limit(k).collect()]
    out = daily.filter(F.col(key).isin(tops)).groupBy("date").pivot(key, tops).agg(F.first(value))
    return out.fillna(0) if zero else out


def product_kpis(stats: DataFrame) -> DataFrame:
    rows = stats.filter("total >= 2")
    return rows.agg(F.count("*").alias("products"), F.count_if((F.col("sentiment_score") < 15) | (F.col("urgent_count") > 0)).alias("need_focus"), rounded(F.avg("sentiment_score"), 1).alias("mean_score"), F.coalesce(F.sum("urgent_count"), F.lit(0)).alias("urgent"))


def browse_products(stats: DataFrame, q: str = "", brand: str | None = None, urgent: bool = False, band: str | None = None, sort: str = "worst") -> DataFrame:
    rows = stats
    if q:
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "item_name", "brand", "product_name")), F.lit(q.lower())))
    if brand:
        rows = rows.filter(F.col("brand") == brand)
    if urgent:
        rows = rows.filter("urgent_count > 0")
    if band:
        rows = rows.filter({"bad": F.col("sentiment_score") < 0, "weak": F.col("sentiment_score") < 15, "good": F.col("sentiment_score") >= 40}[band])
    order = {"worst": F.asc("sentiment_score"), "best": F.desc("sentiment_score"), "most": F.desc("total"), "urgent": F.desc("urgent_count")}[sort]
    return rows.orderBy(order, "product_name")


def _tabs() -> dict[str, Column]:
    return {"all": F.lit(True), "negative": F.col("sentiment") == "negative", "positive": F.col("sentiment") == "positive", "urgent": F.col("urgent"), "with_image": F.size("images") > 0}


def review_tabs(comments: DataFrame) -> DataFrame:
    """Counts behind the tabs of each product's reviews."""
    rows = comments.filter("product_name is not null")
    return rows.groupBy("product_name").agg(*(F.count_if(test).alias(name) for name, test in _tabs().items()))


def review_tab(comments: DataFrame, tab: str = "all", q: str = "") -> DataFrame:
    """The reviews of one tab whose text contains ``q``, letter case aside."""
    rows = comments.filter(_tabs()[tab])
    return rows.filter(F.contains(F.lower("comment"), F.lit(q.lower()))) if q.strip() else rows


def similar_products(stats: DataFrame, k: int = 6) -> DataFrame:
    """(product_name, similar, total): others of the same brand with at least two comments, most first.

    Each brand keeps its k + 1 biggest products before the join, so a big brand doesn't meet itself.
    """
    rows = stats.filter("brand is not null").select("brand", "product_name", "total")
    w = Window.partitionBy("brand").orderBy(F.desc("total"), "product_name")
    peers = rows.filter("total >= 2").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("brand", F.col("product_name").alias("similar"), F.col("total").alias("similar_total"))
    pairs = rows.select("brand", "product_name").join(peers, "brand").filter("product_name <> similar")
    mine = Window.partitionBy("product_name").orderBy(F.desc("similar_total"), "similar")
    return pairs.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k).select("product_name", "similar", "similar_total", "rank")


def product_profile(comments: DataFrame, stats: DataFrame, praise: str, newest: int = 200, issues: int = 6, peers: int = 12) -> DataFrame:
    """Star counts and the main complaints of each product's newest reviews, and the mean score of its peers.

    ``issues`` is an array of (category, count), most first; ``peer_score`` the mean over up to ``peers`` products of the
    same brand. Tasks keep a product's ``newest`` reviews before the shuffle, so a product's history isn't gathered.
    """
    w = Window.partitionBy("product_name").orderBy(F.desc("created_at"), "comment_id")
    narrow = comments.filter("product_name is not null").select("product_name", "created_at", "comment_id", "rating", "sentiment", "category")
    rows = narrow.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= newest)
    stars = F.least(F.lit(5), F.greatest(F.lit(1), js_round(F.col("rating"))))
    complaint = (F.col("sentiment") == "negative") & (F.col("category") != praise)
    by_category = rows.withColumn("category", F.when(complaint, F.col("category"))).groupBy("product_name", "category")
    parts = by_category.agg(F.count("*").alias("n"), *(F.count_if(stars == k).alias(f"s{k}") for k in range(1, 6)))
    ranked = F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct((-F.col("n")).alias("n"), "category"))))  # few categories
    top = F.transform(F.slice(ranked, 1, issues), lambda x: F.struct(x["category"].alias("category"), (-x["n"]).alias("count")))
    out = parts.groupBy("product_name").agg(F.sum("n").alias("reviews"), *(F.sum(f"s{k}").alias(f"stars_{k}") for k in range(1, 6)), top.alias("issues"))
    near = similar_products(stats, peers).join(stats.select(F.col("product_name").alias("similar"), "sentiment_score"), "similar")
    tenths = F.sum(F.round(F.col("sentiment_score") * 10).cast("long"))  # whole numbers, so that ties round alike everywhere
    return out.join(near.groupBy("product_name").agg((rounded(tenths / F.count("*")) / 10).alias("peer_score")), "product_name", "left")


def reply_agent_stats(replies: DataFrame, nobody: str = "ไม่ระบุ") -> DataFrame:
    """(agent, sent, failed, draft, total, last_at): what is neither sent nor failed is a draft."""
    agent = F.coalesce(F.nullif(F.col("agent"), F.lit("")), F.lit(nobody))
    rows = replies.withColumn("agent", agent).groupBy("agent")
    sent, failed = F.count_if(F.col("status") == "sent"), F.count_if(F.col("status") == "failed")
    return rows.agg(sent.alias("sent"), failed.alias("failed"), (F.count("*") - sent - failed).alias("draft"), F.count("*").alias("total"), F.max("at").alias("last_at"))


def reply_agents(stats: DataFrame, nobody: str = "ไม่ระบุ") -> DataFrame:
    """Names of those who replied."""
    return stats.filter(F.col("agent") != nobody).select("agent")


def reply_details(replies: DataFrame, comments: DataFrame, products: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Replies with their comment, its product's name and picture, and the picture of who replied."""
    facts = comments.select("comment_id", *(c for c in ("brand", "product_name", "comment", "rating", "sentiment") if c in comments.columns))
    names = products.select(F.col("item_id").alias("product_name"), "item_name", F.coalesce(F.nullif("thumbnail_url", F.lit("")), F.nullif("image_url", F.lit(""))).alias("product_image"))
    out = replies.join(facts, "comment_id", "left").join(names, "product_name", "left")
    if profiles is None:
        return out
    faces = profiles.filter("avatar <> ''").groupBy(F.col("name").alias("agent")).agg(F.min("avatar").alias("replier_avatar"))
    return out.join(faces, "agent", "left")


def filter_replies(details: DataFrame, agent: str | None = None, status: str | None = None, q: str = "", brands: list[str] | None = None, limit: int = 500) -> DataFrame:
    """Replies, newest first: the newest ``limit`` of an agent and status, then those of the brands, with ``q`` in reply or comment."""
    rows = details
    if agent:
        rows = rows.filter(F.col("agent") == agent)
    if status:
        rows = rows.filter(F.col("status") == status)
    rows = rows.orderBy(F.desc("at"), "comment_id").limit(limit)
    if brands:
        rows = rows.filter(F.col("brand").isin(brands))
    if q:
        rows = rows.filter(F.contains(F.lower("reply_text"), F.lit(q.lower())) | F.contains(F.lower("comment"), F.lit(q.lower())))
    return rows


def urgent_by_brand(comments: DataFrame) -> DataFrame:
    return comments.filter("urgent").groupBy(F.coalesce("brand", F.lit(NO_BRAND)).alias("brand")).agg(F.count("*").alias("urgent"))


def daily_metrics(summary_overall: DataFrame, summary_brands: DataFrame, day: str) -> DataFrame:
    """One row for a day: the overall score and count with a map of brand scores."""
    scores = summary_brands.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("brand", "sentiment_score")))).alias("brand_scores"))
    return summary_overall.select(F.lit(day).cast("date").alias("date"), "total", "sentiment_score", "urgent_count").crossJoin(scores)


def trend(metrics: DataFrame, limit: int = 90, keep: str = "last") -> DataFrame:
    """Up to ``limit`` daily rows in order: the last ones, or the first."""
    rows = metrics.orderBy(F.desc("date") if keep == "last" else F.asc("date")).limit(limit)
    return rows.orderBy("date")
