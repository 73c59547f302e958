"""A global boosted-tree forecast beside seasonal naive and exponential smoothing, chosen by product on a holdout.

The boosted trees are Spark's and the smoothing is ``ets``; their numbers will not equal those of other libraries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions.calendar import TIERS, tier
from marketlens.functions.numeric import rounded
from marketlens.operators.ets import ets
from marketlens.operators.models import Block, blocks, by_product, seasonal_naive
from marketlens.operators.series import densify
from marketlens.sources import commits
from marketlens.sources.scratch import written
from marketlens.sources.tables import upsert_table

LAGS = (1, 7, 14, 28)
LEAST = max(LAGS) + 7  # days that a forecast needs
FEATURES = [*(f"lag_{k}" for k in LAGS), "dow", "month", "doy", *(f"ev_{t}" for t in TIERS), "ev_any"]


def eligible(series: DataFrame, min_history: int = 35, lookback: int = 540, first: int | None = None) -> DataFrame:
    """Dense series of the products with enough days, cut to the lookback; of the ``first`` ids alone where given."""
    newest = series.agg(F.max("date").alias("_top"))
    recent = series.crossJoin(F.broadcast(newest)).filter(F.datediff("_top", "date") < lookback).drop("_top")
    dense = densify(recent, ("units",))
    enough = dense.groupBy("product_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_history).select("product_id")
    enough = enough if first is None else enough.orderBy("product_id").limit(first)
    return dense.join(enough, "product_id", "left_semi")


def _dated(df: DataFrame) -> DataFrame:
    t = tier(F.col("date"))
    out = df.withColumns({"dow": F.dayofweek("date"), "month": F.month("date"), "doy": F.dayofyear("date"), "_t": t})
    return out.withColumns({f"ev_{k}": F.coalesce((F.col("_t") == k).cast("int"), F.lit(0)) for k in TIERS} | {"ev_any": F.col("_t").isNotNull().cast("int")}).drop("_t")


def features(dense: DataFrame) -> DataFrame:
    """Lags, calendar and event columns; the first days, without all lags, are left out."""
    w = Window.partitionBy("product_id").orderBy("date")
    return _dated(dense.withColumns({f"lag_{k}": F.lag("units", k).over(w) for k in LAGS})).filter(F.col(f"lag_{max(LAGS)}").isNotNull())


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def train(rows: DataFrame, depth: int = 5, rounds: int = 20):
    return GBTRegressor(featuresCol="features", labelCol="units", maxDepth=depth, maxIter=rounds, stepSize=0.2, seed=7).fit(_assembled(rows))


def origins(dense: DataFrame, backs: list[int]) -> DataFrame:
    """(product_id, back, ago, date, units): for each number of days left off, the last 28 days before them.

    A product takes part with the ``backs`` that leave it enough days for the lags.
    """
    top = dense.groupBy("product_id").agg(F.max("date").alias("top"), F.count("*").alias("n"))
    rows = dense.select("product_id", "date", "units").join(top, "product_id").withColumn("ago", F.datediff("top", "date"))
    cuts = F.filter(F.array(*map(F.lit, backs)), lambda b: (b <= F.col("ago")) & (F.col("ago") < b + max(LAGS)) & (F.col("n") - b >= LEAST))
    return rows.select("product_id", F.explode(cuts).alias("back"), "ago", "date", "units")


def roll_forward(model, late: DataFrame, horizon: int) -> DataFrame:
    """(product_id, back, step, date, yhat): the model applied day by day, its own forecasts feeding the lags.

    ``late`` holds the last 28 days of each product and origin as one array, so there is no window or join a step; lineage is cut by writing.
    """
    newest = F.array_sort(F.collect_list(F.struct("ago", "units")))
    state = late.groupBy("product_id", "back").agg(F.max("date").alias("date"), F.transform(newest, lambda s: s["units"]).alias("h"))
    state = state.withColumn("out", F.array().cast("array<double>"))
    for step in range(horizon):
        rows = state.withColumn("date", F.date_add("date", 1)).withColumns({f"lag_{k}": F.coalesce(F.get("h", F.lit(k - 1)), F.lit(0.0)) for k in LAGS})
        said = model.transform(_assembled(_dated(rows))).withColumn("yhat", F.greatest(F.lit(0.0), F.col("prediction")))
        state = said.select("product_id", "back", "date", F.concat(F.array("yhat"), F.slice("h", 1, max(LAGS) - 1)).alias("h"), F.concat("out", F.array("yhat")).alias("out"))
        if step % 10 == 9:
            state = written(state, "roll-forward")
    each = F.posexplode("out").alias("k", "yhat")
    first = F.date_sub("date", horizon - 1)
    return state.select("product_id", "back", first.alias("first"), each).select("product_id", "back", (F.col("k") + 1).alias("step"), F.date_add("first", F.col("k")).alias("date"), "yhat")


def _stacked(b: Block, backs: list[int]) -> tuple[Block, np.ndarray, np.ndarray]:
    """(block, product, back): every product as of every origin that leaves it enough days, the longest first."""
    product, back = (x.ravel() for x in np.meshgrid(np.arange(len(b.n)), np.array(backs), indexing="ij"))
    n = b.n[product] - back
    order = np.argsort(-n, kind="stable")
    order = order[n[order] >= LEAST]
    product, back = product[order], back[order]
    return Block(b.y[:, product], n[order], b.first[product]), product, back


LOCAL = "product_id string, back int, step int, date date, model string, yhat double"


def local_models(dense: DataFrame, horizon: int, backs: list[int]) -> DataFrame:
    """(product_id, back, step, date, model, yhat) of seasonal naive and exponential smoothing, from all origins at once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, ids, start in blocks(batches, False, 1 << 20, LEAST):
            b, product, back = _stacked(whole, backs)
            fit, _, _ = ets(b)
            steps = np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(product))
            owner = np.repeat(np.arange(len(product)), horizon)
            dates = (start[product] + b.n)[owner] + steps - 1
            for name, ahead in (("seasonal_naive", seasonal_naive(b).ahead(horizon)), ("ets", fit.ahead(horizon))):
                values = [pa.array(ids).take(pa.array(product[owner])), pa.array(back[owner], pa.int32()), pa.array(steps), pa.array(dates, pa.int32()).cast(pa.date32()), pa.array([name] * len(owner)), pa.array(np.maximum(ahead, 0).T.ravel())]
                yield pa.RecordBatch.from_arrays(values, [c.split()[0] for c in LOCAL.split(", ")])

    return by_product(dense, 1 << 20).mapInArrow(work, LOCAL)


def _wape(actual: Column, guess: Column) -> Column:
    return F.when(F.sum(actual) > 0, rounded(F.try_divide(F.sum(F.abs(guess - actual)), F.sum(actual)) * 100, 1)).otherwise(999.0)


def select_best(forecasts: DataFrame, actual: DataFrame) -> DataFrame:
    """(product_id, model, wape): the lowest WAPE of each product."""
    pairs = forecasts.join(actual.select(F.col("product_id").cast("string").alias("product_id"), "date", "units"), ["product_id", "date"])
    scores = pairs.groupBy("product_id", "model").agg(_wape(F.col("units"), F.col("yhat")).alias("wape"))
    return scores.groupBy("product_id").agg(F.min_by("model", F.struct("wape", "model")).alias("model"), F.min("wape").alias("wape"))


def interval_widths(errors: DataFrame, coverage: float = 0.8) -> DataFrame:
    """(product_id, step, w): the half-width of the interval by step ahead, from (product_id, step, error) of all windows.

    Split conformal: of a step's n absolute errors the ceil((n + 1) * coverage)-th smallest, which a new error stays within with
    at least that chance if it is like them. A step with too few errors for that takes the greatest.
    """
    sizes = errors.groupBy("product_id", "step").agg(F.sort_array(F.collect_list(F.abs("error"))).alias("e"))  # an error a window
    rank = F.ceil(F.round((F.size("e") + 1) * coverage, 9)).cast("int")
    return sizes.select("product_id", "step", F.element_at("e", F.least(rank, F.size("e"))).alias("w"))


def ml_forecast(series: DataFrame, horizon: int = 30, lookback: int = 540, min_history: int = 35, windows: int = 9, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(forecast, meta): product_id, ds, yhat, yhat_lower, yhat_upper; and product_id, model, wape, n_history, horizon.

    The last ``horizon`` days (at most a third of the shortest history) are held out to choose. The 80 % interval comes
    from the chosen model's errors by step over ``windows`` rolling origins, a third of a holdout apart, as many as a product's history
    has room for; steps beyond the holdout take its last width. Nine windows are the fewest but four whose order statistic is at 80 %
    exactly. All origins are rows of one table and are forecast in one pass; the trees for them are trained once, on
    the days before the earliest.
    """
    dense = written(eligible(series, min_history, lookback, first), "ml-series")
    top = written(dense.groupBy("product_id").agg(F.max("date").alias("top"), F.count("*").alias("n")), "ml-top")
    test = min(horizon, max(7, min_history // 3))
    longest = top.agg(F.max("n")).first()[0] or 0
    backs = [b for k in range(windows) if (b := test + k * max(1, test // 3)) == test or longest - b >= LEAST]
    early = dense.join(top, "product_id").filter(F.datediff("top", "date") >= backs[-1]).select(*dense.columns)
    late = written(origins(dense, [0, *backs]), "ml-origins")
    trees = roll_forward(train(features(dense)), late.filter("back = 0"), horizon)
    if backs[-1] <= longest - LEAST:
        trees = trees.unionByName(roll_forward(train(features(early)), late.filter("back > 0"), test))
    trees = trees.select(F.col("product_id").cast("string").alias("product_id"), "back", "step", "date", F.lit("gbt").alias("model"), "yhat")
    every = written(local_models(dense, horizon, [0, *backs]).unionByName(trees), "ml-forecasts")
    actual = dense.select(F.col("product_id").cast("string").alias("product_id"), "date", "units")
    tried = every.filter(F.col("back") > 0).filter(F.col("step") <= test)
    best = written(select_best(tried.filter(F.col("back") == test), actual), "ml-best")
    errors = tried.join(best.select("product_id", "model"), ["product_id", "model"]).join(actual, ["product_id", "date"]).select("product_id", "step", (F.col("yhat") - F.col("units")).alias("error"))
    width = interval_widths(errors).select("product_id", F.col("step").alias("at"), "w")
    ahead = every.filter("back = 0").join(best, ["product_id", "model"]).withColumn("at", F.least("step", F.lit(test))).join(width, ["product_id", "at"])
    forecast = ahead.select("product_id", F.col("date").alias("ds"), rounded(F.col("yhat"), 2).alias("yhat"), rounded(F.greatest(F.lit(0.0), F.col("yhat") - F.col("w")), 2).alias("yhat_lower"), rounded(F.col("yhat") + F.col("w"), 2).alias("yhat_upper"))
    meta = best.join(top.select(F.col("product_id").cast("string").alias("product_id"), F.col("n").alias("n_history")), "product_id").withColumn("horizon", F.lit(horizon))
    return forecast, meta


def store_forecast(spark: SparkSession, path: str, forecast: DataFrame, meta: DataFrame) -> None:
    """Upsert a forecast and its facts into the tables ``path``/points (by product_id, ds) and ``path``/meta (by product_id)."""
    for name, rows, keys in (("points", forecast, ["product_id", "ds"]), ("meta", meta, ["product_id"])):
        table = f"{path}/{name}"
        if commits.exists(spark, table):
            upsert_table(spark, table, rows, keys)
        else:
            commits.replace(spark, table, rows, base=0)


def read_forecast(spark: SparkSession, path: str, product_id: str | None = None) -> DataFrame:
    """Stored points with their product's model, wape, n_history and horizon, of one product or all."""
    points, meta = commits.read(spark, f"{path}/points"), commits.read(spark, f"{path}/meta")
    if product_id is not None:
        points = points.filter(F.col("product_id") == product_id)
    return points.join(meta, "product_id", "left")
