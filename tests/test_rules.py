"""The rule engine at its edges."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from marketlens.functions import calendar, rules
from marketlens.functions.numeric import js_round, normal_cdf, rounded


def _label(spark, rows, **kw):
    df = spark.createDataFrame([(str(i), t, r) for i, (t, r) in enumerate(rows)], "comment_id string, comment string, rating double")
    return [r for r in rules.label_comments(df, **kw).orderBy(F.col("comment_id").cast("int")).collect()]


def test_sentiment_and_negation(spark):
    got = _label(spark, [("ไม่แพง", None), ("ไม่ดี", None), ("ดี", None), ("แย่", 5.0), ("", 3.0), (None, 1.0), ("good love", 2.0), ("", float("nan"))])
    assert [r.sentiment for r in got] == ["positive", "negative", "positive", "neutral", "neutral", "negative", "neutral", "neutral"]


def test_urgency_is_raised_and_released(spark):
    got = _label(spark, [("ภูมิแพ้หายไป", 5.0), ("ของปลอม", None), ("คืนเงิน", 3.0), ("ok", 2.0), ("ok", 1.0), ("scam", 4.0)])
    assert [(r.urgent, r.severity) for r in got] == [(False, 4), (True, 9), (True, 8), (True, 7), (True, 7), (False, 4)]


def test_category_takes_the_first_of_equals(spark):
    got = _label(spark, [("ส่งช้า กล่องบุบ", 1.0), ("zzz", 1.0), ("ชอบ", None)])
    assert [r.category for r in got] == ["การจัดส่ง", rules.OTHER, rules.PRAISE]


def test_labels_from_elsewhere(spark):
    labels = spark.createDataFrame([("0", "negative", "nonsense", 3.0, "s" * 200, None, False)], "comment_id string, sentiment string, category string, severity double, summary string, suggested_action string, urgent boolean")
    a, b = _label(spark, [("ok", 5.0), ("ok", 5.0)], labels=labels)
    assert (a.sentiment, a.category, a.severity, len(a.summary), a.analyzed_by) == ("negative", rules.OTHER, 3, 120, "ai")
    assert b.analyzed_by == "rule"


def test_label_replies(spark):
    body = '{"results": [{"index": 0, "sentiment": "positive", "severity": 2}, {"index": 1, "sentiment": "negative"}]}'
    df = spark.createDataFrame([(1, f"```json\n{body}\n```"), (2, f"here it is: {body} done"), (3, "nothing")], "batch int, reply string")
    got = rules.parse_label_json(df).orderBy("batch", "index").collect()
    assert [(r.batch, r["index"], r.sentiment) for r in got] == [(1, 0, "positive"), (1, 1, "negative"), (2, 0, "positive"), (2, 1, "negative")]


@pytest.mark.parametrize("score,word", [(40.0, "ดีมาก"), (15.0, "ค่อนข้างดี"), (-14.9, "ทรงตัว/ผสม"), (-15.0, "ค่อนข้างแย่"), (-40.0, "แย่ ต้องรีบแก้")])
def test_direction(spark, score, word):
    assert spark.range(1).select(rules.direction(F.lit(score))).first()[0] == word


def test_calendar(spark):
    days = {"2024-11-11": "mega", "2024-12-12": "mega", "2024-06-06": "major", "2024-05-05": "double", "2024-04-13": "songkran", "2024-12-31": "newyear", "2024-01-01": "newyear", "2024-02-11": "cny", "2024-02-12": None, "2024-02-29": "payday", "2024-03-29": "payday", "2024-03-15": "midmonth", "2025-01-30": "cny", "2025-01-31": "payday", "2023-02-10": None}
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", calendar.tier(F.col("d").cast("date")).alias("t"))
    assert {r.d: r.t for r in df.collect()} == days
    assert calendar.event_calendar(spark, "2024-04-01", 30).filter("tier = 'songkran'").count() == 3


def test_rounding(spark):
    row = spark.range(1).select(rounded(F.lit(-2.5)), js_round(F.lit(-2.5)), rounded(F.lit(12.25), 1), normal_cdf(F.lit(0.0)), normal_cdf(F.lit(1.6449))).first()
    assert row[0] == -3.0 and row[1] == -2 and row[2] == 12.3 and abs(row[3] - 0.5) < 1e-6 and abs(row[4] - 0.95) < 1e-4


def test_replies_and_kinds(spark):
    templates = {"positive": ["a", "b", "c", "d"], "neutral": "n", "hard": "h", "negative": "x"}
    rows = [("7", "positive", rules.OTHER, False), ("", "positive", rules.OTHER, False), ("2", "negative", rules.OTHER, True), ("3", "negative", "การจัดส่ง", True), ("4", "neutral", None, False), ("5", "negative", None, False)]
    df = spark.createDataFrame(rows, "comment_id string, sentiment string, category string, urgent boolean")
    got = {r.comment_id: r.reply for r in rules.suggest_reply(df, templates, {"การจัดส่ง": "ship"}).collect()}
    assert got == {"7": "abcd"[ord("7") % 4], "": "a", "2": "h", "3": "ship", "4": "n", "5": "x"}
    kinds = spark.createDataFrame([("N95 mask", None), ("", ""), ("USB cable", "x"), ("หมวก", None)], "n string, b string").select(rules.product_kind(F.col("n"), F.col("b")).alias("k"))
    kinds = kinds.withColumn("f", rules.weather_factors(F.col("k")))
    assert [(r.k, r.f) for r in kinds.collect()] == [("health_air", ["pm2_5"]), ("generic", []), ("electronics", []), ("apparel_fashion", ["temp_mean", "precip"])]


def test_last_business_day(spark):
    df = spark.createDataFrame([(date(2024, 3, 5),), (date(2024, 6, 1),), (date(2024, 9, 30),)], "d date").select(calendar.last_business_day(F.col("d")))
    assert [r[0] for r in df.collect()] == [date(2024, 3, 29), date(2024, 6, 28), date(2024, 9, 30)]


def test_filters_by_a_label_read_the_text_once(spark):
    """A filter below the labels would lower the text anew for each word it asks for."""
    rows = spark.createDataFrame([(1, "good", 5.0), (2, "bad", 1.0), (3, None, None)], "comment_id long, comment string, rating double")
    lexicon = rules.Lexicon(positive=["good", "fine"], negative=["bad", "late"], negation="not ", categories={"a": ["late", "slow"], "b": ["dear", "bad"]}, known=["a", "b"], other="other", praise="praise")
    complaints = rules.label_comments(rows, lexicon).filter("sentiment = 'negative' and category <> 'praise'").select("comment_id", "category")
    assert [tuple(r) for r in complaints.collect()] == [(2, "b")]
    assert complaints._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
