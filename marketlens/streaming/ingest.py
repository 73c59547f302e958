"""Incremental ingest: a high-water mark with an overlap, made idempotent by upserts.

The mark is the newest created_at of the target minus the overlap. Rows at or before it are late and are not read again
unless asked for; rows after it are labelled and upserted by comment_id, the last copy of a comment winning. So reading a
file twice changes nothing. The target is partitioned by day and has a commit log (``sources.commits``): a run writes the
days it touches anew and makes them count by one rename. So a crash leaves the state before or after the run, the run
can be repeated, and readers never see half of it. ``commits.vacuum`` deletes what was replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from marketlens.functions.rules import THAI, Lexicon, label_comments
from marketlens.sources import commits
from marketlens.sources.comments import fetch_new
from marketlens.sources.scratch import written
from marketlens.sources.tables import latest

OVERLAP_MINUTES, BACKFILL_DAYS = 60, 30


def watermark(target: DataFrame, overlap_minutes: int = OVERLAP_MINUTES) -> datetime | None:
    """One row to the driver, from the newest day alone; None for an empty target."""
    day = target.agg(F.max("day")).first()[0]
    newest = target.filter(F.col("day") == F.lit(day)).agg(F.max("created_at")).first()[0] if day is not None else None
    return None if newest is None else newest - timedelta(minutes=overlap_minutes)


def ingest_batch(spark: SparkSession, comments: DataFrame, target: str, lexicon: Lexicon = THAI, as_of: datetime | None = None, labels: DataFrame | None = None) -> int:
    """One incremental run over (comment_id, created_at, comment, rating, ...) into the table ``target``.

    Returns how many comments were fetched. Without a target the last 30 days before ``as_of`` are filled in.
    """
    mark = watermark(commits.read(spark, target)) if commits.exists(spark, target) else None
    since = None if mark is None else F.lit(mark).cast("timestamp")
    fresh = fetch_new(comments, since, BACKFILL_DAYS, 0, None if as_of is None else F.lit(as_of).cast("timestamp"), "comment")
    return _store(spark, fresh, target, lexicon, labels)


def _store(spark: SparkSession, fresh: DataFrame, target: str, lexicon: Lexicon, labels: DataFrame | None) -> int:
    once = latest(fresh, ["comment_id"], ["created_at"])
    labelled = written(label_comments(once, lexicon, labels).withColumn("day", F.to_date("created_at")), "labelled")
    n = labelled.count()
    if n:
        commits.upsert(spark, target, labelled, ["comment_id"], "day")
    return n


def stream_ingest(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, lexicon: Lexicon = THAI, on_batch: Callable[[int, int, int], None] | None = None, take_late: bool = False
) -> StreamingQuery:
    """Ingest Parquet files as they land in ``source``; each batch is upserted.

    Comments at or before the target's mark are left out, as in a batch run, or stored too with ``take_late``; ``on_batch``
    is told the batch's number, how many comments were stored and how many were late. The upsert keeps the last copy of
    a comment, which a deduplication within a watermark (the first copy) would not.
    """
    stream = spark.readStream.schema(schema).parquet(source).filter("comment is not null and comment <> ''")

    def work(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        mark = watermark(commits.read(session, target)) if commits.exists(session, target) else None
        fresh = F.lit(True) if mark is None else F.col("created_at") > F.lit(mark).cast("timestamp")
        n = _store(session, batch if take_late else batch.filter(fresh), target, lexicon, None)
        if on_batch:
            on_batch(number, n, batch.filter(~fresh).count())

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_copies(stream: DataFrame, delay_minutes: int = OVERLAP_MINUTES) -> DataFrame:
    """Of a stream of comments the rows that are newer than every copy of their comment seen before.

    The newest time of each comment is the state. It goes once the watermark, which trails the newest row of the stream by
    ``delay_minutes``, has passed it: older copies are late from the next batch on and are dropped by the watermark itself,
    as are newer ones that come as late. So the state holds the comments of the last ``delay_minutes`` alone, however long
    the stream runs.
    """
    columns = stream.columns
    rows = stream.withWatermark("created_at", f"{delay_minutes} minutes").withColumn("_ms", F.unix_millis("created_at"))

    def work(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else None
        every = pd.concat(list(frames), ignore_index=True)
        newest = every.loc[[every["_ms"].idxmax()]]
        at = int(newest["_ms"].iloc[0])
        if seen is None or at > seen:
            state.update((at,))
            yield newest[columns]
        state.setTimeoutTimestamp(max(at, seen or 0, state.getCurrentWatermarkMs()) + 1)

    return rows.groupBy("comment_id").applyInPandasWithState(work, stream.schema, "at long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_newest(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, lexicon: Lexicon = THAI, delay_minutes: int = OVERLAP_MINUTES, files_per_batch: int = 1000, on_batch: Callable[[int, int], None] | None = None
) -> StreamingQuery:
    """Ingest Parquet files as ``stream_ingest`` does, with the newest copies kept as state in place of the target's mark.

    A batch never reads the target to find out what is new; files that come again, late or out of order change nothing that
    is newer. ``on_batch`` is told the batch's number and how many comments were stored.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).filter("comment is not null and comment <> '' and comment_id is not null and created_at is not null")

    def work(batch: DataFrame, number: int) -> None:
        n = _store(batch.sparkSession, batch, target, lexicon, None)
        if on_batch:
            on_batch(number, n)

    fresh = newest_copies(stream, delay_minutes)
    return fresh.writeStream.outputMode("append").foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_effort(steps: list[tuple[str, Callable[[], object]]]) -> tuple[str, list[str]]:
    """Run independent steps; a failing one becomes a warning. Returns the status (success or partial) and warnings."""
    warnings: list[str] = []
    for name, step in steps:
        try:
            step()
        except Exception as e:  # noqa: BLE001  the next step runs all the same
            warnings.append(f"{name}: {str(e).splitlines()[0][:200] if str(e) else type(e).__name__}")
    return ("partial" if warnings else "success"), warnings
