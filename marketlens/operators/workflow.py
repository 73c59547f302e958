"""Triage and reply work on comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.tables import latest, row_numbers, upsert

STATUSES = ("new", "in_progress", "resolved")


def triage_patch(comments: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments after the last valid patch of each, and the log rows of all valid patches.

    ``patches`` has (comment_id, status, assignee, note, at, by); ``comments`` has status, assignee, note, handled_at.
    """
    valid = patches.filter(F.col("status").isin(*STATUSES))
    last = latest(valid, ["comment_id"], ["at"])
    update = last.select("comment_id", "status", "assignee", "note", F.when(F.col("status") == "resolved", F.col("at")).alias("handled_at"))
    known = update.join(comments, "comment_id", "left_semi")
    log = valid.join(comments, "comment_id", "left_semi").select("at", "by", "comment_id", F.concat(F.lit("triage:"), "status").alias("action"))
    return upsert(comments, known, ["comment_id"]), log


def apply_reply_outcomes(comments: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments after replies went out: sent ones are resolved, others in progress; and the log rows."""
    last = latest(outcomes, ["comment_id"], ["at"])
    sent = F.col("outcome") == "sent"
    update = last.select("comment_id", F.when(sent, "resolved").otherwise("in_progress").alias("status"), F.col("reply_text").alias("note"), F.when(sent, F.col("at")).alias("handled_at"))
    known = update.join(comments, "comment_id", "left_semi")
    return upsert(comments, known, ["comment_id"]), outcomes.select("at", "by", "comment_id", F.concat(F.lit("reply:"), "outcome").alias("action"))


def dispatch_plan(replies: DataFrame, shops: DataFrame, max_length: int = 500, batch: int = 100) -> DataFrame:
    """(shop_id, batch, comment_id, text): trimmed, non-empty replies by shop, in batches; without a shop none is sent."""
    text = F.substring(F.trim("reply_text"), 1, max_length)
    rows = replies.withColumn("text", text).filter("text <> ''").join(shops.filter("shop_id is not null"), "comment_id")
    rows = row_numbers(rows.select("shop_id", "comment_id", "text"), "shop_id", "comment_id")
    return rows.select("shop_id", F.floor((F.col("nth") - 1) / batch).cast("int").alias("batch"), "comment_id", "text")
