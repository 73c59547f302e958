"""Table upkeep without a table format: upserts, backfills, latest rows, exports and logs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.sources import commits
from marketlens.sources.scratch import written


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in ``order``; partial aggregation, no sort of a key's history."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*keys, "_r.*")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``base`` with ``updates`` inserted or laid over, touching only the columns that the update has.

    Several updates of a key count by ``order`` (the last), or any of them where no order is given.
    """
    updates = latest(updates, keys, order) if order else updates.dropDuplicates(keys)
    new = updates.select(*keys, *(F.col(c).alias(f"_u_{c}") for c in updates.columns if c not in keys), F.lit(True).alias("_u"))
    joined = base.withColumn("_b", F.lit(True)).join(new, keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c in updates.columns:
            return F.when(F.col("_u"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return joined.select(*(value(c) for c in base.columns))


def backfill(base: DataFrame, lookup: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with nulls of ``columns`` filled from ``lookup``; values that are there stay."""
    found = lookup.dropDuplicates([key]).select(key, *(F.col(c).alias(f"_l_{c}") for c in columns))
    joined = base.join(found, key, "left")
    return joined.select(*(F.coalesce(c, f"_l_{c}").alias(c) if c in columns else F.col(c) for c in base.columns))


def backfill_counts(base: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """(filled, missing): rows with a null that the lookup can and can't fill."""
    gaps = base.filter(F.col(column).isNull())
    hit = lookup.filter(F.col(column).isNotNull()).select(key).distinct().withColumn("_hit", F.lit(1))
    return gaps.join(hit, key, "left").agg(F.count("_hit").alias("filled"), F.count(F.when(F.col("_hit").isNull(), 1)).alias("missing"))


def replace(df: DataFrame, path: str) -> None:
    """Delete all, then insert, in one commit: readers see the rows before or the rows after, a crash loses none."""
    commits.replace(df.sparkSession, path, df)


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> None:
    """Upsert into a table with a commit log, which is written whole (``commits.upsert`` writes the partitions that change)."""
    commits.change(spark, path, lambda state: upsert(state, updates, keys, order))


def csv_line(columns: list[str]) -> Column:
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", F.array(*(F.coalesce(quote(c), F.lit("")) for c in columns)))


def export_csv(df: DataFrame, path: str, limit: int = 10_000) -> None:
    """A byte-order mark and the header unquoted, then values quoted with quotes doubled, nulls empty; at most ``limit`` rows in the order given."""
    lines = df.limit(limit).select(csv_line(df.columns).alias("line")).coalesce(1)
    head = "\ufeff" + ",".join(df.columns)

    def write(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([head])], ["line"])
            first = False
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["line"])
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([head])], ["line"])

    lines.mapInArrow(write, "line string").write.mode("overwrite").text(path)


def snapshot(summary: DataFrame, window_days: int, at: datetime) -> DataFrame:
    """One row that holds a whole summary as JSON, to append."""
    return summary.select(F.lit(at).alias("generated_at"), F.lit(window_days).alias("window_days"), F.to_json(F.struct(*summary.columns)).alias("summary"))


def run_log(spark: SparkSession, status: str, fetched: int, analyzed: int, watermark: datetime | None, message: str, at: datetime) -> DataFrame:
    if status not in ("success", "partial", "error"):
        raise ValueError(f"unknown status {status!r}")
    schema = "at timestamp, status string, fetched long, analyzed long, watermark timestamp, message string"
    return spark.createDataFrame([(at, status, fetched, analyzed, watermark, message)], schema)


def is_due(table: DataFrame, column: str, today: date, least_days: int) -> bool:
    """Whether the newest value of ``column`` is at least ``least_days`` old (or there is none): one row to the driver."""
    newest = table.agg(F.max(F.col(column).cast("date"))).first()[0]
    return newest is None or (today - newest).days >= least_days


def refresh_start(table: DataFrame, column: str, today: date, first_days: int = 760, later_days: int = 20) -> date:
    """Where a refresh begins: far back for an empty table, a little otherwise."""
    return today - timedelta(days=first_days if not table.select(column).filter(F.col(column).isNotNull()).head(1) else later_days)


def introspect(df: DataFrame) -> tuple[list[tuple[str, str, bool]], int, list]:
    """Columns with types and nullability, the row count, three samples."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], df.count(), df.limit(3).collect()


@dataclass(frozen=True)
class Key:
    """One part of an order. As in the orders of comments, nulls stand last upwards and first downwards."""

    value: Column
    down: bool = False

    def order(self) -> Column:
        return self.value.desc_nulls_first() if self.down else self.value.asc_nulls_last()

    def behind(self, mark: object) -> Column:
        """Whether a row stands behind one whose value is ``mark``."""
        if self.down:
            return self.value.isNotNull() if mark is None else self.value < F.lit(mark)
        return F.lit(False) if mark is None else (self.value > F.lit(mark)) | self.value.isNull()


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """A page of rows; sizes are clamped to 1..200."""
    size = min(200, max(1, size))
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def seek(df: DataFrame, keys: list[Key], after: Row | None = None, size: int = 50) -> DataFrame:
    """The page behind the row whose ``cursor`` is ``after`` (the first page without), with a column cursor of its own.

    Rows before the page are filtered out, so each task keeps ``size`` rows however far the page lies, and rows that are
    added or go meanwhile don't shift it. The keys must tell all rows apart. Sizes are clamped to 1..200.
    """
    size = min(200, max(1, size))
    if after is not None:
        marks = [after[f"k{i}"] for i in range(len(keys))]
        level = [reduce(lambda a, b: a & b, [keys[j].value.eqNullSafe(F.lit(marks[j])) for j in range(i)], F.lit(True)) & keys[i].behind(marks[i]) for i in range(len(keys))]
        df = df.filter(reduce(lambda a, b: a | b, level))
    return df.withColumn("cursor", F.struct(*(k.value.alias(f"k{i}") for i, k in enumerate(keys)))).orderBy(*(k.order() for k in keys)).limit(size)


def row_numbers(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds nth, counted from 1 within ``key`` by ``order``, without gathering a key in one task.

    Rows are range-partitioned by key and order; a window numbers them within a partition, and each key's counts in the
    partitions before (a row a partition and key) are added. Rows alike in both have neighbouring numbers.
    """
    ranged = written(df.repartitionByRange(key, order).withColumn("_p", F.spark_partition_id()), "row-numbers")
    counts = ranged.groupBy("_p", key).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", key, before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_p", key).orderBy(order))
    return ranged.withColumn("_r", nth).join(offsets, ["_p", key]).withColumn("nth", (F.col("_r") + F.col("_before")).cast("long")).drop("_p", "_r", "_before")


def global_percent_rank(df: DataFrame, column: str) -> DataFrame:
    """Adds percent_rank of ``column``, descending, without gathering the table in one task.

    Values are counted first; the distinct values are range-partitioned, each partition's count gives the ranks before
    it (one row a partition), and a window runs within partitions only. Equal values share a rank.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    ranged = counts.repartitionByRange(F.desc(column)).withColumn("_p", F.spark_partition_id())
    ranged = written(ranged, "percent-rank")
    parts = ranged.groupBy("_p").agg(F.sum("_n").alias("_size"))
    before = parts.select("_p", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    total = parts.agg(F.sum("_size").alias("_total"))
    within = Window.partitionBy("_p").orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranged.withColumn("_above", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(F.broadcast(before), "_p").crossJoin(F.broadcast(total))
    rank = F.when(F.col("_total") > 1, (F.col("_above") + F.col("_before")) / (F.col("_total") - 1)).otherwise(0.0)
    return df.join(ranks.select(column, rank.alias("percent_rank")), column)
