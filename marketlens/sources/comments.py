"""Reading, cleaning and searching review comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.sources.tables import Key

#: The standard fields.
FIELDS = {
    "comment_id": "string", "brand": "string", "shop_id": "string", "product_name": "string", "rating": "double", "comment_text": "string", "username": "string", "created_at": "timestamp", "order_sn": "string",
    "seller_reply": "string", "seller_reply_at": "timestamp", "seller_reply_hidden": "boolean", "images": "array<string>", "platform": "string",
}
EPOCHS = {"created_at", "seller_reply_at"}


def read_comments(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The standard fields by a mapping field -> column; fields without a column are null.

    Whole-number times are epoch seconds, of which 0 means none.
    """
    kinds = dict(raw.dtypes)

    def field(name: str, kind: str) -> Column:
        source = mapping.get(name)
        if source is None or source not in kinds:
            return F.lit(None).cast(kind).alias(name)
        if name in EPOCHS and kinds[source] in ("int", "bigint"):
            return F.timestamp_seconds(F.nullif(F.col(source), F.lit(0))).alias(name)
        if kind == "double":
            return F.expr(f"try_cast(`{source}` AS double)").alias(name)
        return F.col(source).cast(kind).alias(name)

    return raw.select(*(field(n, k) for n, k in FIELDS.items()))


def normalize(comments: DataFrame) -> DataFrame:
    """Non-finite ratings and empty replies become null, empty images and rows without an id go."""
    rating = F.when(~F.isnan("rating") & (F.abs("rating") < float("inf")), F.col("rating"))
    images = F.filter(F.coalesce("images", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    rows = comments.filter(F.coalesce("comment_id", F.lit("")) != "")
    return rows.withColumns({"rating": rating, "seller_reply": F.nullif(F.col("seller_reply"), F.lit("")), "images": images})


def has_text(column: str = "comment_text") -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def fetch_new(comments: DataFrame, since: Column | None = None, backfill_days: int = 30, limit: int = 0, as_of: Column | None = None, text: str = "comment_text") -> DataFrame:
    """Comments with text after ``since``, or of the last ``backfill_days`` before ``as_of``, oldest first."""
    if since is not None:
        fresh = F.col("created_at") > since
    else:
        fresh = F.col("created_at") >= (as_of if as_of is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(backfill_days))
    rows = comments.filter(has_text(text) & fresh).orderBy("created_at", "comment_id")
    return rows.limit(limit) if limit else rows


def search(comments: DataFrame, **f) -> DataFrame:
    """Filters: brands, product, sentiment, category, status, assignee, urgent, replied, min_severity, since, until (inclusive), q."""
    tests: list[Column] = []
    for name in ("product", "sentiment", "category", "status", "assignee"):
        if f.get(name):
            tests.append(F.col("product_name" if name == "product" else name) == f[name])
    if f.get("brands"):
        tests.append(F.col("brand").isin(list(f["brands"])))
    if f.get("urgent"):
        tests.append(F.col("urgent"))
    if f.get("replied") is not None:
        tests.append(F.col("seller_reply").isNotNull() if f["replied"] else F.col("seller_reply").isNull())
    if f.get("min_severity") is not None:
        tests.append(F.col("severity") >= f["min_severity"])
    if f.get("since"):
        tests.append(F.to_date("created_at") >= F.lit(f["since"]).cast("date"))
    if f.get("until"):
        tests.append(F.to_date("created_at") <= F.lit(f["until"]).cast("date"))
    if f.get("q"):
        tests.append(F.contains(F.lower("comment"), F.lit(f["q"].lower())))
    return reduce(lambda df, t: df.filter(t), tests, comments)


def visible(df: DataFrame, brands: list[str] | None) -> DataFrame:
    """Row-level scope: all rows for no list, else those of the brands (a null brand is hidden)."""
    return df if brands is None else df.filter(F.col("brand").isin(brands))


#: Orders of a comment page; ids break ties.
def comment_keys(kind: str) -> list[Key]:
    created, by_id = F.col("created_at"), Key(F.col("comment_id"))
    if kind == "oldest":
        return [Key(created), by_id]
    if kind == "severity":
        return [Key(F.col("severity"), down=True), Key(created, down=True), by_id]
    if kind == "rating":
        return [Key(F.col("rating")), by_id]
    if kind == "smart":
        rank = F.when(F.col("status") == "new", 0).when(F.col("status") == "in_progress", 1).otherwise(2)
        return [Key(rank), Key(F.col("severity"), down=True), Key(created, down=True), by_id]
    return [Key(created, down=True), by_id]


def comment_order(kind: str) -> list[Column]:
    return [k.order() for k in comment_keys(kind)]


def enrich(comments: DataFrame, products: DataFrame) -> DataFrame:
    """Adds item_name and picture; an empty thumbnail counts as missing."""
    facts = products.select(F.col("item_id").alias("product_name"), "item_name", F.coalesce(F.nullif("thumbnail_url", F.lit("")), F.nullif("image_url", F.lit(""))).alias("picture"))
    return comments.join(facts, "product_name", "left")


def storefront_link(shop_id: Column, item_id: Column, base: str) -> Column:
    """A product page from numeric ids, else null."""
    return F.when(shop_id.rlike("^[0-9]+$") & item_id.rlike("^[0-9]+$"), F.concat(F.lit(base), shop_id, F.lit("/"), item_id))
