"""Review jobs."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from marketlens.functions.rules import CATEGORY_REPLIES, OTHER, REPLIES, label_comments, parse_label_json, product_kind, seed_index, suggest_reply, weather_factors
from marketlens.operators import reviews as rv
from marketlens.operators import workflow as wf
from marketlens.plans.sql import NEEDS, PARTS, sql
from marketlens.sources import comments as cm
from marketlens.sources import commits
from marketlens.sources import fixtures as fx
from marketlens.sources import tables as tb
from marketlens.sources import text_index
from marketlens.sources.scratch import tables_dir, written

L = fx.LEXICON
DAYS, AS_OF = 2, "2024-01-04"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _vote(w: str, sign: int) -> str:
    return f"CASE WHEN contains(t, '{L.negation}{w}') THEN {-sign} WHEN contains(t, '{w}') THEN {sign} ELSE 0 END"


_HITS = {c: " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in ws) for c, ws in L.categories.items()}
_SCORE = "count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative"
COUNTS = f"count(*) AS total, {_SCORE}, round(avg(rating), 2) AS avg_rating, count(*) FILTER (urgent) AS urgent_count, round(CAST(count(*) FILTER (sentiment = 'positive') - count(*) FILTER (sentiment = 'negative') AS DOUBLE) / count(*) * 100, 1) AS sentiment_score"
PARTS["lab"] = f"""SELECT comment_id, created_at, username, buyer, brand, product_name, rating, comment, has_image, status, sentiment, cat AS category, urg AND NOT calm AS urgent, CAST(CASE WHEN urg AND calm THEN least(sev, 4) ELSE sev END AS INTEGER) AS severity FROM (
  SELECT *, hard OR soft OR low OR sev >= 7 AS urg, coalesce(rating >= 4, FALSE) OR (rating IS NULL AND sentiment = 'positive') AS calm FROM (
  SELECT *, greatest(CASE WHEN sentiment = 'negative' THEN 6 ELSE 0 END, CASE WHEN hard THEN 9 WHEN soft THEN 8 ELSE 0 END, CASE WHEN low THEN 7 ELSE 0 END) AS sev,
    CASE WHEN sentiment = 'positive' THEN '{L.praise}' WHEN greatest({", ".join(f"h{i}" for i in range(len(_HITS)))}) = 0 THEN '{L.other}' {" ".join(f"WHEN h{i} = greatest({', '.join(f'h{j}' for j in range(len(_HITS)))}) THEN '{c}'" for i, c in enumerate(_HITS))} END AS cat FROM (
  SELECT *, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS sentiment, {", ".join(f"{h} AS h{i}" for i, h in enumerate(_HITS.values()))},
    {_any(L.danger)} AS hard, {_any(L.warning)} AS soft, coalesce(rating <= 2, FALSE) AS low FROM (
  SELECT *, {" + ".join([_vote(w, 1) for w in L.positive] + [_vote(w, -1) for w in L.negative])} + CASE WHEN rating >= 4 THEN 1 WHEN rating <= 2 THEN -2 ELSE 0 END AS s FROM (SELECT *, lower(comment) AS t FROM com)))))"""
NEEDS["lab"] = ["com"]
PARTS["dt"] = f"SELECT CAST(created_at + INTERVAL 7 HOUR AS DATE) AS date, {COUNTS} FROM lab GROUP BY 1"
PARTS["dbt"] = f"SELECT CAST(created_at + INTERVAL 7 HOUR AS DATE) AS date, coalesce(brand, '{rv.NO_BRAND}') AS brand, {COUNTS} FROM lab GROUP BY 1, 2"
PARTS["dct"] = f"SELECT CAST(created_at + INTERVAL 7 HOUR AS DATE) AS date, category, count(*) AS total FROM lab WHERE sentiment = 'negative' AND category <> '{L.praise}' GROUP BY 1, 2"
PARTS["ps"] = f"""SELECT product_name, s.total, s.positive, s.neutral, s.negative, s.avg_rating, s.urgent_count, s.sentiment_score, item_name, price, coalesce(prod.brand, seen) AS brand
  FROM (SELECT coalesce(product_name, '{rv.NO_PRODUCT}') AS product_name, {COUNTS}, max(brand) AS seen FROM lab GROUP BY 1) s LEFT JOIN prod ON prod.item_id = s.product_name"""
PARTS["win"] = f"SELECT *, coalesce(nullif(brand, ''), '{rv.NO_BRAND}') AS bk, least(5, greatest(1, floor(rating + 0.5))) AS stars FROM lab WHERE created_at >= TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL {DAYS} DAY"
for _p in ("dt", "dbt", "dct"):
    NEEDS[_p] = ["lab"]
NEEDS["ps"] = ["lab", "prod"]
NEEDS["win"] = ["lab"]
STARS = ", ".join(f"count(*) FILTER (stars = {k}) AS stars_{k}" for k in range(1, 6))
DIRECTION = "CASE WHEN sentiment_score >= 40 THEN 'ดีมาก' WHEN sentiment_score >= 15 THEN 'ค่อนข้างดี' WHEN sentiment_score > -15 THEN 'ทรงตัว/ผสม' WHEN sentiment_score > -40 THEN 'ค่อนข้างแย่' ELSE 'แย่ ต้องรีบแก้' END AS direction"


def labelled(s, d):
    return label_comments(fx.comments(s, d), L)


def _summary(s, d):
    return rv.window_summary(labelled(s, d), DAYS, F.lit(f"{AS_OF} 00:00:00").cast("timestamp"), L.other, L.praise)


def _stats(s, d):
    return rv.product_stats(labelled(s, d), fx.products(s, d))


def _triaged(s, d):
    """Comments with triage columns, after patches from the event stream."""
    base = fx.comments(s, d).select("comment_id", F.lit("new").alias("status"), F.lit(None).cast("string").alias("assignee"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("timestamp").alias("handled_at"))
    e = fx.table(s, d, "events")
    status = F.when(F.col("event_type") == "click", "in_progress").when(F.col("event_type") == "purchase", "resolved").when(F.col("event_type") == "error", "bogus").otherwise("new")
    patches = e.select((F.col("event_id") % 1500).alias("comment_id"), status.alias("status"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("assignee"), F.lit("n").alias("note"), F.col("ts").cast("timestamp").alias("at"), F.lit("x").alias("by"))
    return wf.triage_patch(base, patches)[0].groupBy("status").agg(F.count("*").alias("comments"), F.count("handled_at").alias("handled"), F.count("assignee").alias("assigned"))


def _dispatch(s, d):
    docs = fx.table(s, d, "documents")
    replies = docs.select(F.col("doc_id").alias("comment_id"), F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("reply_text"))
    shops = docs.select(F.col("doc_id").alias("comment_id"), F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")).alias("shop_id"))
    return wf.dispatch_plan(replies, shops, 500, 20).select("shop_id", "batch", "comment_id", F.length("text").alias("n"))


def _upserted(s, d):
    """All parts, with updates under re-keyed ids, of which some are known and some new."""
    base = fx.table(s, d, "part").select("p_partkey", "p_brand", "p_size", F.lit("keep").alias("note"))
    new = fx.table(s, d, "part").select((F.col("p_partkey") * 3).alias("p_partkey"), F.concat("p_brand", F.lit("!")).alias("p_brand"))
    return tb.upsert(base, new, ["p_partkey"])


def _gaps(s, d):
    """(item_id, brand) of all parts, with nulls to be filled."""
    return fx.products(s, d).select("item_id", "brand"), fx.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_partkey") % 10 > 0, F.col("p_brand")).alias("brand"))


def _details(s, d):
    return rv.reply_details(fx.replies(s, d), labelled(s, d), fx.products(s, d), fx.profiles(s, d))


def _outcomes(s, d):
    """Comments by status after replies went out or failed."""
    base = fx.comments(s, d).select("comment_id", F.lit("new").alias("status"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("timestamp").alias("handled_at"))
    e = fx.table(s, d, "events")
    sent = e.select((F.col("event_id") % 1500).alias("comment_id"), F.when(F.col("event_type") == "purchase", "sent").otherwise("failed").alias("outcome"), F.lit("t").alias("reply_text"), F.col("ts").cast("timestamp").alias("at"), F.lit("x").alias("by"))
    return wf.apply_reply_outcomes(base, sent)[0].groupBy("status").agg(F.count("*").alias("comments"), F.count("handled_at").alias("handled"))


def _given(s, d):
    """Comments labelled from replies in JSON, bare, fenced or broken, laid over the rules."""
    k = F.col("doc_id")
    body = F.concat(F.lit('{"results":[{"index":0,"sentiment":"'), F.when(F.col("quality") == 1, "positive").otherwise("negative"), F.lit('","severity":2}]}'))
    text = F.when(k % 3 == 0, body).when(k % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.lit("no labels"))
    parsed = parse_label_json(fx.table(s, d, "labels").select(k.alias("comment_id"), text.alias("reply")))
    out = label_comments(fx.comments(s, d), L, parsed)
    given = F.col("analyzed_by") == "ai"
    return out.agg(F.count("*").alias("comments"), F.count_if(given).alias("by_label"), F.count_if(given & (F.col("sentiment") == "positive")).alias("positive_labels"))


def _category_pivot(s, d):
    """The two biggest categories of complaints by day, under names that don't tell them."""
    out = rv.pivot_top(rv.daily_trend(labelled(s, d), by="category", praise=L.praise), "category", "total", 2, True)
    return out.select("date", *(F.col(c).alias(f"top_{i}") for i, c in enumerate(c for c in out.columns if c != "date")))


#: The stand-in categories by the names that replies go by.
_THAI = {"delivery": "การจัดส่ง", "quality": "คุณภาพสินค้า", "price": "ราคา/โปรโมชั่น", "other": OTHER}


def _thai(column):
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in _THAI.items() for x in pair)), F.col(column)), F.col(column))


def _issues(column):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["category"], x["count"].cast("string"))), ", ")


AGENT = "CASE WHEN user_id % 8 IN (0, 1) THEN 'ไม่ระบุ' ELSE 'agent' || (user_id % 8) END"

MAPPING = {"comment_id": "id", "brand": "shop", "rating": "stars", "comment_text": "body", "created_at": "made", "seller_reply": "answer", "seller_reply_at": "answered", "images": "pics", "username": "gone"}


def _mapped(s, d):
    rows = cm.normalize(cm.read_comments(fx.raw_comments(s, d), MAPPING))
    return rows.select("comment_id", "brand", "rating", F.length("comment_text").alias("n"), F.unix_timestamp("created_at").alias("created"), "seller_reply", F.unix_timestamp("seller_reply_at").alias("replied"), F.size("images").alias("pictures"), "username")


def _texts(s, d):
    """Summaries and actions, of rules and of longer labels from elsewhere."""
    rows = fx.comments(s, d)
    given = rows.filter("comment_id % 3 = 0").select(
        "comment_id", F.lit("neutral").alias("sentiment"), F.lit("quality").alias("category"), F.lit(1.0).alias("severity"), F.col("comment").alias("summary"), F.when(F.col("comment_id") % 2 == 0, F.col("comment")).alias("suggested_action"), F.lit(False).alias("urgent")
    )
    return label_comments(rows, L, given).select("comment_id", "summary", "suggested_action", "analyzed_by")


def _indexed_search(s, d):
    """The search over a stored table, partitioned by day, through its trigram index."""
    path = f"{tables_dir(s)}/comments-{uuid.uuid4().hex}"
    rows = labelled(s, d).withColumn("day", F.to_date("created_at")).drop("images")
    commits.upsert(s, path, written(rows, "search-labels"), ["comment_id"], "day")
    text_index.update(s, path, f"{path}-index", "comment")
    return cm.search(text_index.candidates(s, path, f"{path}-index", "thst"), sentiment="negative", min_severity=6, q="thst").select("comment_id")


def _third_page(s, d):
    """The third page by the smart order, from the last rows of the pages before."""
    rows = written(labelled(s, d).select("comment_id", "status", "severity", "created_at"), "page-labels")  # labelled once, as in a stored table
    keys, after = cm.comment_keys("smart"), None
    for _ in range(2):
        last = tb.seek(rows, keys, after, 40).collect()
        if not last:
            break
        after = last[-1].cursor
    return tb.seek(rows, keys, after, 40).select("comment_id", "status", "severity")


SMART = "SELECT comment_id, status, severity FROM lab ORDER BY CASE status WHEN 'new' THEN 0 WHEN 'in_progress' THEN 1 ELSE 2 END, severity DESC, created_at DESC NULLS FIRST, comment_id LIMIT 40 OFFSET 80"

JOBS = {
    "mapped_comments": (
        _mapped,
        """SELECT CAST(doc_id AS VARCHAR) AS comment_id, source AS brand, CAST(CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN NULL ELSE 1 + doc_id % 5 END AS DOUBLE) AS rating, CAST(length(text) AS INTEGER) AS n, CAST(floor(epoch(ts)) AS BIGINT) AS created,
        CASE WHEN doc_id % 4 > 0 THEN 'thanks' END AS seller_reply, CASE WHEN doc_id % 3 > 0 THEN 1700000000 + doc_id END AS replied, 1 AS pictures, CAST(NULL AS VARCHAR) AS username FROM documents LEFT JOIN events ON doc_id = event_id WHERE doc_id % 13 > 0""",
    ),
    "label_texts": (
        _texts,
        sql(
            """SELECT comment_id, substr(comment, 1, CASE WHEN comment_id % 3 = 0 THEN 120 ELSE 80 END) AS summary, CASE WHEN comment_id % 6 = 0 THEN substr(comment, 1, 300) ELSE '' END AS suggested_action, CASE WHEN comment_id % 3 = 0 THEN 'ai' ELSE 'rule' END AS analyzed_by FROM com""",
            "com",
        ),
    ),
    "indexed_search": (_indexed_search, sql("SELECT comment_id FROM lab WHERE sentiment = 'negative' AND severity >= 6 AND contains(lower(comment), 'thst')", "lab")),
    "keyset_page": (_third_page, sql(SMART, "lab")),
    "export_lines": (
        lambda s, d: labelled(s, d).select(tb.csv_line(["comment_id", "brand", "comment", "severity"]).alias("line")),
        sql("""SELECT concat_ws(',', '"' || comment_id || '"', coalesce('"' || replace(brand, '"', '""') || '"', ''), coalesce('"' || replace(comment, '"', '""') || '"', ''), '"' || severity || '"') AS line FROM lab""", "lab"),
    ),
    "summary_snapshot": (
        lambda s, d: tb.snapshot(rv.brand_stats(labelled(s, d)).select("brand", "total", "urgent_count"), 30, datetime(2024, 1, 4)).select(F.unix_timestamp("generated_at").alias("generated_at"), "window_days", "summary"),
        sql(f"SELECT CAST(epoch(TIMESTAMP '2024-01-04') AS BIGINT) AS generated_at, 30 AS window_days, CAST(to_json({{'brand': coalesce(brand, '{rv.NO_BRAND}'), 'total': count(*), 'urgent_count': count(*) FILTER (urgent)}}) AS VARCHAR) AS summary FROM lab GROUP BY coalesce(brand, '{rv.NO_BRAND}')", "lab"),
    ),
    "rule_labels": (lambda s, d: labelled(s, d).select("comment_id", "sentiment", "category", "severity", "urgent"), sql("SELECT comment_id, sentiment, category, severity, urgent FROM lab", "lab")),
    "product_stats": (_stats, sql("SELECT * FROM ps", "ps")),
    "brand_stats": (lambda s, d: rv.brand_stats(labelled(s, d)), sql(f"SELECT coalesce(brand, '{rv.NO_BRAND}') AS brand, {COUNTS} FROM lab GROUP BY 1", "lab")),
    "product_list": (
        lambda s, d: rv.listed(_stats(s, d), "product", limit=20).select("product_name", "sentiment_score"),
        sql("SELECT product_name, sentiment_score FROM ps ORDER BY sentiment_score, product_name LIMIT 20", "ps"),
    ),
    "suggested_replies": (
        lambda s, d: suggest_reply(labelled(s, d).withColumn("category", _thai("category")), other=_THAI["other"]).groupBy("reply").agg(F.count("*").alias("comments")),
        sql(
            f""", r AS (SELECT *, CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _THAI.items())} ELSE category END AS cat,
            list_reduce(list_transform(string_split(CAST(comment_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) % 4 AS pick FROM lab)
            SELECT CASE WHEN sentiment = 'positive' THEN CASE pick {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(REPLIES["positive"]))} END WHEN urgent AND coalesce(cat, '{_THAI["other"]}') = '{_THAI["other"]}' THEN '{REPLIES["hard"]}'
            {" ".join(f"WHEN cat = '{k}' THEN '{v}'" for k, v in CATEGORY_REPLIES.items())} WHEN sentiment = 'neutral' AND NOT urgent THEN '{REPLIES["neutral"]}' WHEN urgent THEN '{REPLIES["hard"]}' ELSE '{REPLIES["negative"]}' END AS reply, count(*) AS comments FROM r GROUP BY 1""",
            "lab",
        ),
    ),
    "category_stats": (lambda s, d: rv.category_stats(labelled(s, d), L.praise), sql(f"SELECT category, count(*) AS total FROM lab WHERE sentiment = 'negative' AND category <> '{L.praise}' GROUP BY 1", "lab")),
    "daily_trend": (lambda s, d: rv.daily_trend(labelled(s, d)), sql("SELECT * FROM dt", "dt")),
    "daily_brand_trend": (lambda s, d: rv.daily_trend(labelled(s, d), by="brand"), sql("SELECT * FROM dbt", "dbt")),
    "category_daily": (lambda s, d: rv.daily_trend(labelled(s, d), by="category", praise=L.praise), sql("SELECT * FROM dct", "dct")),
    "product_sentiment_daily": (
        lambda s, d: rv.product_sentiment_daily(labelled(s, d)),
        sql(
            "SELECT product_name, CAST(created_at AS DATE) AS date, count(*) AS n, round(avg(rating), 2) AS avg_rating, count(*) FILTER (sentiment = 'positive') AS pos, count(*) FILTER (sentiment = 'negative') AS neg, count(*) FILTER (sentiment = 'neutral') AS neu, round(CAST(count(*) FILTER (sentiment = 'positive') - count(*) FILTER (sentiment = 'negative') AS DOUBLE) / count(*), 3) AS net FROM lab WHERE product_name IS NOT NULL GROUP BY 1, 2",
            "lab",
        ),
    ),
    "window_summary_overall": (lambda s, d: _summary(s, d)["overall"], sql(f", o AS (SELECT {COUNTS}, {STARS} FROM win) SELECT *, {DIRECTION} FROM o", "win")),
    "window_summary_brands": (lambda s, d: _summary(s, d)["brands"], sql(f", o AS (SELECT bk AS brand, {COUNTS}, {STARS} FROM win GROUP BY 1) SELECT *, {DIRECTION} FROM o", "win")),
    "brand_slice": (
        lambda s, d: rv.brand_slice(_summary(s, d)["brands"], "src1").select("brand", "total", "positive_rate"),
        sql("SELECT bk AS brand, count(*) AS total, round(CAST(count(*) FILTER (sentiment = 'positive') AS DOUBLE) / count(*) * 100) AS positive_rate FROM win WHERE bk = 'src1' GROUP BY 1", "win"),
    ),
    "window_categories": (
        lambda s, d: _summary(s, d)["categories"],
        sql("SELECT category, count(*) AS count FROM win GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 8", "win"),
    ),
    "window_issues": (
        lambda s, d: _summary(s, d)["issues"],
        sql(f"SELECT category, count(*) AS count FROM win WHERE sentiment = 'negative' AND category <> '{L.praise}' GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 8", "win"),
    ),
    "daily_metrics": (
        lambda s, d: rv.daily_metrics(_summary(s, d)["overall"], _summary(s, d)["brands"], AS_OF).select("date", "total", "sentiment_score", "urgent_count", F.explode("brand_scores").alias("brand", "brand_score")),
        sql(f", o AS (SELECT {COUNTS} FROM win), b AS (SELECT bk AS brand, {COUNTS} FROM win GROUP BY 1) SELECT DATE '{AS_OF}' AS date, o.total, o.sentiment_score, o.urgent_count, b.brand, b.sentiment_score AS brand_score FROM o CROSS JOIN b", "win"),
    ),
    "smart_order": (
        lambda s, d: tb.page(labelled(s, d), cm.comment_order("smart"), 3, 40).select("comment_id", "status", "severity"),
        sql(SMART, "lab"),
    ),
    "category_pivot": (
        _category_pivot,
        sql(", t AS (SELECT category, row_number() OVER (ORDER BY sum(total) DESC, category) AS r FROM dct GROUP BY 1) SELECT date, CAST(coalesce(max(total) FILTER (r = 1), 0) AS BIGINT) AS top_0, CAST(coalesce(max(total) FILTER (r = 2), 0) AS BIGINT) AS top_1 FROM dct JOIN t USING (category) WHERE r <= 2 GROUP BY 1", "dct"),
    ),
    "top_issues": (
        lambda s, d: _summary(s, d)["brand_issues"],
        sql(f"SELECT bk AS brand_key, category, count(*) AS count, CAST(row_number() OVER (PARTITION BY bk ORDER BY count(*) DESC, category) AS INTEGER) AS rank FROM win WHERE sentiment = 'negative' AND category <> '{L.praise}' GROUP BY 1, 2 QUALIFY rank <= 5", "win"),
    ),
    "urgent_queue": (
        lambda s, d: _summary(s, d)["urgent"].select("comment_id", "severity", "category"),
        sql("SELECT comment_id, severity, category FROM win WHERE urgent ORDER BY severity DESC, comment_id LIMIT 100", "win"),
    ),
    "period_compare": (
        lambda s, d: rv.period_compare(rv.daily_trend(labelled(s, d)), DAYS),
        sql(
            f""", p AS (SELECT *, CASE WHEN (SELECT max(date) FROM dt) - date < {DAYS} THEN 'current' WHEN (SELECT max(date) FROM dt) - date < {2 * DAYS} THEN 'previous' END AS period FROM dt)
            SELECT period, CAST(sum(total) AS BIGINT) AS total, CAST(sum(urgent_count) AS BIGINT) AS urgent, round(CAST(sum(positive) - sum(negative) AS DOUBLE) / sum(total) * 100, 1) AS score, round(CAST(sum(positive) AS DOUBLE) / sum(total) * 100) AS pos_rate, round(sum(coalesce(avg_rating, 0) * total) / sum(total), 2) AS avg_rating FROM p WHERE period IS NOT NULL GROUP BY 1""",
            "dt",
        ),
    ),
    "brand_movers": (
        lambda s, d: rv.brand_movers(rv.daily_trend(labelled(s, d), by="brand"), DAYS),
        sql(
            f""", p AS (SELECT *, (SELECT max(date) FROM dbt) - date AS back FROM dbt), q AS (SELECT brand, sum(CASE WHEN back < {DAYS} THEN total ELSE 0 END) AS n1, sum(CASE WHEN back >= {DAYS} THEN total ELSE 0 END) AS n0,
            sum(CASE WHEN back < {DAYS} THEN sentiment_score * total ELSE 0 END) AS w1, sum(CASE WHEN back >= {DAYS} THEN sentiment_score * total ELSE 0 END) AS w0 FROM p WHERE back < {2 * DAYS} GROUP BY 1 HAVING n1 >= 10 AND n0 >= 10)
            SELECT brand, round(w1 / n1, 1) AS current, round(w0 / n0, 1) AS previous, round(round(w1 / n1, 1) - round(w0 / n0, 1), 1) AS change FROM q""",
            "dbt",
        ),
    ),
    "product_kpis": (
        lambda s, d: rv.product_kpis(_stats(s, d)),
        sql("SELECT count(*) AS products, count(*) FILTER (sentiment_score < 15 OR urgent_count > 0) AS need_focus, round(avg(sentiment_score), 1) AS mean_score, CAST(coalesce(sum(urgent_count), 0) AS BIGINT) AS urgent FROM ps WHERE total >= 2", "ps"),
    ),
    "browse_products": (lambda s, d: rv.browse_products(_stats(s, d), q="ring", band="weak").select("product_name", "sentiment_score"), sql("SELECT product_name, sentiment_score FROM ps WHERE contains(lower(concat_ws(' ', item_name, brand, product_name)), 'ring') AND sentiment_score < 15", "ps")),
    "similar_products": (
        lambda s, d: rv.similar_products(_stats(s, d)),
        sql("SELECT a.product_name, b.product_name AS similar, b.total AS similar_total, CAST(row_number() OVER (PARTITION BY a.product_name ORDER BY b.total DESC, b.product_name) AS INTEGER) AS rank FROM ps a JOIN ps b ON a.brand = b.brand AND a.product_name <> b.product_name AND b.total >= 2 QUALIFY rank <= 6", "ps"),
    ),
    "review_tabs": (
        lambda s, d: rv.review_tabs(labelled(s, d)).withColumnRenamed("all", "reviews"),
        sql("SELECT product_name, count(*) AS reviews, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (urgent) AS urgent, count(*) FILTER (has_image) AS with_image FROM lab WHERE product_name IS NOT NULL GROUP BY 1", "lab"),
    ),
    "review_tab": (
        lambda s, d: rv.review_tab(labelled(s, d), "with_image", "THST").select("comment_id", "product_name"),
        sql("SELECT comment_id, product_name FROM lab WHERE has_image AND contains(lower(comment), 'thst')", "lab"),
    ),
    "product_profile": (
        lambda s, d: rv.product_profile(labelled(s, d), _stats(s, d), L.praise).withColumn("issues", _issues("issues")),
        sql(
            f""", n AS (SELECT *, least(5, greatest(1, floor(rating + 0.5))) AS stars FROM lab WHERE product_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY created_at DESC, comment_id) <= 200),
            i AS (SELECT product_name, category, count(*) AS c FROM n WHERE sentiment = 'negative' AND category <> '{L.praise}' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY count(*) DESC, category) <= 6),
            t AS (SELECT product_name, string_agg(category || ':' || c, ', ' ORDER BY c DESC, category) AS issues FROM i GROUP BY 1),
            p AS (SELECT a.product_name, b.sentiment_score FROM ps a JOIN ps b ON a.brand = b.brand AND a.product_name <> b.product_name AND b.total >= 2 QUALIFY row_number() OVER (PARTITION BY a.product_name ORDER BY b.total DESC, b.product_name) <= 12),
            m AS (SELECT product_name, round(CAST(sum(CAST(round(sentiment_score * 10) AS BIGINT)) AS DOUBLE) / count(*)) / 10 AS peer_score FROM p GROUP BY 1)
            SELECT product_name, count(*) AS reviews, {STARS}, coalesce(any_value(issues), '') AS issues, any_value(peer_score) AS peer_score FROM n LEFT JOIN t USING (product_name) LEFT JOIN m USING (product_name) GROUP BY 1""",
            "ps",
        ),
    ),
    "reply_agent_stats": (
        lambda s, d: rv.reply_agent_stats(fx.replies(s, d)).withColumn("last_at", F.unix_timestamp("last_at")),
        f"""WITH r AS (SELECT {AGENT} AS agent, event_type, ts FROM events) SELECT agent, count(*) FILTER (event_type = 'purchase') AS sent, count(*) FILTER (event_type = 'error') AS failed,
        count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS draft, count(*) AS total, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_at FROM r GROUP BY 1""",
    ),
    "reply_agents": (lambda s, d: rv.reply_agents(rv.reply_agent_stats(fx.replies(s, d))), "SELECT DISTINCT 'agent' || (user_id % 8) AS agent FROM events WHERE user_id % 8 NOT IN (0, 1)"),
    "reply_details": (
        lambda s, d: _details(s, d).groupBy("brand", "item_name", "product_image", "sentiment", "replier_avatar").agg(F.count("*").alias("replies")),
        sql(
            f""", a AS (SELECT 'agent' || (n_nationkey % 9) AS agent, min(lower(n_name) || '.png') AS replier_avatar FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 1),
            r AS (SELECT event_id, CASE WHEN user_id % 8 = 0 THEN NULL WHEN user_id % 8 = 1 THEN '' ELSE 'agent' || (user_id % 8) END AS agent FROM events)
            SELECT lab.brand, item_name, coalesce(nullif(thumbnail_url, ''), nullif(image_url, '')) AS product_image, sentiment, replier_avatar, count(*) AS replies FROM r LEFT JOIN lab ON event_id = comment_id LEFT JOIN prod ON item_id = product_name LEFT JOIN a USING (agent) GROUP BY 1, 2, 3, 4, 5""",
            "lab",
            "prod",
        ),
    ),
    "filter_replies": (
        lambda s, d: rv.filter_replies(_details(s, d), agent="agent3", status="sent", q="THE", brands=["src1", "src2", "src3", "src4"]).select("comment_id", "brand", "reply_text"),
        sql(
            """, r AS (SELECT event_id AS comment_id, 'Thanks for purchase' AS reply_text, ts FROM events WHERE user_id % 8 = 3 AND event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 500)
            SELECT comment_id, com.brand, reply_text FROM r JOIN com USING (comment_id) WHERE com.brand IN ('src1', 'src2', 'src3', 'src4') AND (contains(lower(reply_text), 'the') OR contains(lower(comment), 'the'))""",
            "com",
        ),
    ),
    "urgent_by_brand": (lambda s, d: rv.urgent_by_brand(labelled(s, d)), sql(f"SELECT coalesce(brand, '{rv.NO_BRAND}') AS brand, count(*) AS urgent FROM lab WHERE urgent GROUP BY 1", "lab")),
    "search_comments": (
        lambda s, d: cm.search(labelled(s, d), sentiment="negative", min_severity=6, since="2024-01-01", until="2024-01-20", q="thst").select("comment_id"),
        sql("SELECT comment_id FROM lab WHERE sentiment = 'negative' AND severity >= 6 AND CAST(created_at AS DATE) BETWEEN '2024-01-01' AND '2024-01-20' AND contains(lower(comment), 'thst')", "lab"),
    ),
    "comment_page": (
        lambda s, d: tb.page(cm.visible(labelled(s, d), ["src1", "src2", "src3"]), cm.comment_order("severity"), 2, 20).select("comment_id", "severity"),
        sql("SELECT comment_id, severity FROM lab WHERE brand IN ('src1', 'src2', 'src3') ORDER BY severity DESC, created_at DESC, comment_id LIMIT 20 OFFSET 20", "lab"),
    ),
    "enrich_comments": (
        lambda s, d: cm.enrich(fx.comments(s, d), fx.products(s, d)).select("comment_id", "item_name", "picture"),
        sql("SELECT comment_id, item_name, coalesce(nullif(thumbnail_url, ''), nullif(image_url, '')) AS picture FROM com LEFT JOIN prod ON item_id = product_name", "com", "prod"),
    ),
    "fetch_new": (
        lambda s, d: cm.fetch_new(fx.comments(s, d), F.lit("2024-01-01 02:00:00").cast("timestamp"), limit=50, text="comment").select("comment_id"),
        sql("SELECT comment_id FROM com WHERE comment <> '' AND created_at > TIMESTAMP '2024-01-01 02:00:00' ORDER BY created_at, comment_id LIMIT 50", "com"),
    ),
    "product_kinds": (
        lambda s, d: fx.table(s, d, "part").select("p_partkey", product_kind(F.col("p_name"), F.col("p_brand"), {"metal": ["ring", "bolt"], "small": ["small"]}).alias("kind")),
        "SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_brand), 'ring') OR contains(lower(p_name || ' ' || p_brand), 'bolt') THEN 'metal' WHEN contains(lower(p_name || ' ' || p_brand), 'small') THEN 'small' ELSE 'generic' END AS kind FROM part",
    ),
    "reply_choice": (
        lambda s, d: fx.table(s, d, "customer").select("c_custkey", seed_index(F.col("c_name"), 4).alias("choice")),
        "SELECT c_custkey, CAST(list_reduce(list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) % 4 AS INTEGER) AS choice FROM customer",
    ),
    "triage_status": (
        _triaged,
        sql(
            """, pt AS (SELECT event_id % 1500 AS comment_id, CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'resolved' ELSE 'new' END AS status FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY event_id % 1500 ORDER BY ts DESC) = 1),
            j AS (SELECT coalesce(pt.status, 'new') AS status, pt.status AS p FROM com LEFT JOIN pt USING (comment_id)) SELECT status, count(*) AS comments, count(*) FILTER (p = 'resolved') AS handled, count(p) AS assigned FROM j GROUP BY 1""",
            "com",
        ),
    ),
    "dispatch_plan": (
        _dispatch,
        "WITH r AS (SELECT doc_id AS comment_id, source AS shop_id, least(500, length(trim(text))) AS n FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0 AND trim(text) <> '') SELECT shop_id, CAST((row_number() OVER (PARTITION BY shop_id ORDER BY comment_id) - 1) // 20 AS INTEGER) AS batch, comment_id, CAST(n AS INTEGER) AS n FROM r",
    ),
    "upsert": (
        _upserted,
        """SELECT coalesce(n.k, b.p_partkey) AS p_partkey, coalesce(n.v, b.p_brand) AS p_brand, b.p_size, CASE WHEN b.p_partkey IS NOT NULL THEN 'keep' END AS note
        FROM part b FULL JOIN (SELECT p_partkey * 3 AS k, p_brand || '!' AS v FROM part) n ON n.k = b.p_partkey""",
    ),
    "backfill": (
        lambda s, d: tb.backfill(*_gaps(s, d), "item_id", ["brand"]),
        sql("SELECT item_id, coalesce(prod.brand, CASE WHEN p_partkey % 10 > 0 THEN p_brand END) AS brand FROM prod LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = item_id", "prod"),
    ),
    "backfill_counts": (
        lambda s, d: tb.backfill_counts(*_gaps(s, d), "item_id", "brand"),
        sql("SELECT count(*) FILTER (p_partkey % 10 > 0) AS filled, count(*) FILTER (p_partkey % 10 = 0) AS missing FROM prod JOIN part ON CAST(p_partkey AS VARCHAR) = item_id WHERE prod.brand IS NULL", "prod"),
    ),
    "storefront_links": (
        lambda s, d: fx.comments(s, d).select("comment_id", cm.storefront_link(F.col("shop_id"), F.col("product_name"), "https://shop.example/").alias("link")),
        sql("SELECT comment_id, CASE WHEN shop_id <> 'shop' AND product_name IS NOT NULL THEN 'https://shop.example/' || shop_id || '/' || product_name END AS link FROM com", "com"),
    ),
    "reply_outcomes": (
        _outcomes,
        sql(
            """, l AS (SELECT event_id % 1500 AS comment_id, event_type = 'purchase' AS ok FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 1500 ORDER BY ts DESC) = 1)
            SELECT CASE WHEN ok IS NULL THEN 'new' WHEN ok THEN 'resolved' ELSE 'in_progress' END AS status, count(*) AS comments, count(*) FILTER (ok) AS handled FROM com LEFT JOIN l USING (comment_id) GROUP BY 1""",
            "com",
        ),
    ),
    "weather_factors": (
        lambda s, d: fx.table(s, d, "part").select("p_partkey", F.array_join(weather_factors(F.element_at(F.array(*map(F.lit, ("health_air", "apparel_fashion", "electronics", "home_cooling"))), (F.col("p_partkey") % 4 + 1).cast("int"))), ",").alias("factors")),
        "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pm2_5' WHEN 1 THEN 'temp_mean,precip' WHEN 2 THEN '' ELSE 'temp_mean' END AS factors FROM part",
    ),
    "given_labels": (
        _given,
        sql(
            """, j AS (SELECT doc_id AS comment_id, doc_id % 3 <> 2 AS parsed, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS mood FROM labels)
            SELECT count(*) AS comments, count(*) FILTER (j.parsed) AS by_label, count(*) FILTER (j.parsed AND j.mood = 'positive') AS positive_labels FROM com LEFT JOIN j USING (comment_id)""",
            "com",
        ),
    ),
}
