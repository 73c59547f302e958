"""Per-product forecasting models, back-tested and chosen, for blocks of products at once.

The recursions (Holt-Winters, Croston, TSB) aren't window functions. A task takes a block of products as a matrix of days by
products and steps through the days, each step for all products together; so the work a product and day is a few vector
operations, in as many tasks as the number of products asks for. A series is dense; its days' weekday counts from 0 for
Sunday. Older days than the lookback (540 by default) before a product's newest are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.numeric import rounded
from marketlens.functions.rules import weather_factors
from marketlens.sources.scratch import written

BLOCK = 1024  # products of a block


@dataclass
class Block:
    """Series of many products, the longest first: y[:n[p], p] are the days of product p, first[p] the weekday of its first."""

    y: np.ndarray
    n: np.ndarray
    first: np.ndarray

    @property
    def there(self) -> np.ndarray:
        return np.arange(len(self.y))[:, None] < self.n

    def mean(self) -> np.ndarray:
        return np.where(self.there, self.y, 0.0).sum(0) / np.maximum(self.n, 1)

    def active(self, day: int) -> int:
        """How many products, from the left, have this day."""
        return int(np.searchsorted(-self.n, -day, "left"))

    def late(self, days: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, days, there) of each product's last ``days`` days, the newest first."""
        at = self.n - 1 - np.arange(days)[:, None]
        there = at >= 0
        return np.where(there, np.take_along_axis(self.y, np.maximum(at, 0), 0) if len(self.y) else 0.0, 0.0), at, there

    def until(self, n: np.ndarray) -> Block:
        return Block(self.y, n, self.first)

    def of(self, products: np.ndarray) -> Block:
        return Block(self.y[:, products], self.n[products], self.first[products])


@dataclass
class Fit:
    """ahead(h): forecasts of the h days that follow, by day and product; past(): fitted values; ok: where the model could be had."""

    ahead: Callable[[int], np.ndarray]
    past: Callable[[], np.ndarray]
    ok: np.ndarray


def _weekly(ratio: np.ndarray, b: Block) -> np.ndarray:
    """Median ratio of each weekday, 1 where there is none, scaled to a mean of 1; from ratios (nan: left out) of the newest days back."""
    weeks = -(-len(ratio) // 7)
    padded = np.full((weeks * 7, ratio.shape[1]), np.nan)
    padded[: len(ratio)] = ratio
    cube = np.sort(padded.reshape(weeks, 7, -1), axis=0)  # nan last
    count = (~np.isnan(cube)).sum(0)
    low, high = (np.take_along_axis(cube, np.maximum(k, 0)[None], 0)[0] for k in ((count - 1) // 2, np.minimum(count // 2, np.maximum(count - 1, 0))))
    back = np.where(count > 0, (low + high) / 2, 1.0)  # by days back from the last, modulo 7
    days = (b.first + b.n - 1 - np.arange(7)[:, None]) % 7
    w = np.take_along_axis(back, days, 0)  # by weekday
    mean = w.sum(0) / 7
    return w / np.where(mean == 0, 1.0, mean)


def _weekdays(week: np.ndarray, b: Block, days: np.ndarray) -> np.ndarray:
    """The weekday factors of these days, counted from the first of each product."""
    return np.take_along_axis(week, (b.first + days) % 7, 0)


def _coming(b: Block, h: int) -> np.ndarray:
    return b.n + np.arange(h)[:, None]


def _every(b: Block) -> np.ndarray:
    return np.broadcast_to(np.arange(len(b.y))[:, None], b.y.shape)


def moving_average(b: Block) -> Fit:
    level = b.late(28)[0].sum(0) / np.clip(b.n, 1, 28)
    y, _, there = b.late(84)
    with np.errstate(divide="ignore", invalid="ignore"):
        week = _weekly(np.where(there & (y > 0) & (level > 0), y / level, np.nan), b)
    at = lambda days: np.maximum(level * _weekdays(week, b, days), 0)
    return Fit(lambda h: at(_coming(b, h)), lambda: at(_every(b)), b.n > 0)


def linear_seasonal(b: Block) -> Fit:
    y, i, there = b.late(180)
    use = there & (y > 0)
    k = use.sum(0)
    x, v = np.where(use, i, 0.0), np.where(use, y, 0.0)
    mx, mv = x.sum(0) / np.maximum(k, 1), v.sum(0) / np.maximum(k, 1)
    off = np.where(use, i - mx, 0.0)
    spread = (off**2).sum(0)
    slope = np.where(spread > 0, (off * np.where(use, y - mv, 0.0)).sum(0) / np.where(spread > 0, spread, 1), 0.0)
    start = np.where(k > 0, mv, b.mean()) - slope * mx
    trend = lambda t: np.maximum(start + slope * t, 0)
    y, i, there = b.late(365)
    line = trend(i)
    with np.errstate(divide="ignore", invalid="ignore"):
        week = _weekly(np.where(there & (y > 0) & (line > 0), y / line, np.nan), b)
    at = lambda days: trend(days) * _weekdays(week, b, days)
    return Fit(lambda h: at(_coming(b, h)), lambda: at(_every(b)), b.n > 0)


# The smoothing constants that the models below default to.
def holt_winters(b: Block, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.25) -> Fit:
    ok = b.n >= 21
    y = np.where(b.there, b.y, 0.0)
    level, trend = y[:14].sum(0) / 14, (y[7:14].sum(0) / 7 - y[:7].sum(0) / 7) / 7
    off = np.where(b.there, y - level, 0.0)
    season = np.array([off[r::7].sum(0) / np.maximum(-(-(b.n - r) // 7), 1) for r in range(7)])  # by days from the first, modulo 7
    fitted = np.zeros(y.shape)
    for i in range(len(y)):
        a = b.active(i)
        if not a:
            break
        v, s, old = y[i, :a], season[i % 7, :a], level[:a].copy()
        fitted[i, :a] = np.maximum(old + trend[:a] + s, 0)
        level[:a] = alpha * (v - s) + (1 - alpha) * (old + trend[:a])
        trend[:a] = beta * (level[:a] - old) + (1 - beta) * trend[:a]
        season[i % 7, :a] = gamma * (v - level[:a]) + (1 - gamma) * s
    ahead = lambda h: np.maximum(level + np.arange(1, h + 1.0)[:, None] * trend + np.take_along_axis(season, _coming(b, h) % 7, 0), 0)
    return Fit(ahead, lambda: fitted, ok)


def _flat(b: Block, rate: np.ndarray) -> Fit:
    rate = np.maximum(rate, 0.0)
    return Fit(lambda h: np.tile(rate, (h, 1)), lambda: np.tile(rate, (len(b.y), 1)), b.n > 0)


def croston(b: Block, alpha: float = 0.1, correction: float = 1.0) -> Fit:
    size, gap, last, count = np.zeros(len(b.n)), np.ones(len(b.n)), np.zeros(len(b.n)), np.zeros(len(b.n), int)
    for i in range(len(b.y)):
        sold = np.flatnonzero(b.y[i, : b.active(i)] > 0)
        v, old = b.y[i, sold], count[sold] > 0
        size[sold] = np.where(old, alpha * v + (1 - alpha) * size[sold], v)
        gap[sold] = np.where(old, alpha * (i - last[sold]) + (1 - alpha) * gap[sold], i + 1.0)
        last[sold] = i
        count[sold] += 1
    return _flat(b, np.where(count < 2, b.mean(), size / gap) * correction)


def sba(b: Block, alpha: float = 0.1) -> Fit:
    return croston(b, alpha, 1 - alpha / 2)


def tsb(b: Block, alpha: float = 0.1, beta: float = 0.05) -> Fit:
    sold = (b.y > 0) & b.there
    k = sold.sum(0)
    chance, size = k / np.maximum(b.n, 1), np.where(sold, b.y, 0.0).sum(0) / np.maximum(k, 1)
    for i in range(len(b.y)):
        a = b.active(i)
        v, hit = b.y[i, :a], sold[i, :a]
        size[:a] = np.where(hit, alpha * v + (1 - alpha) * size[:a], size[:a])
        chance[:a] = np.where(hit, beta, 0.0) + (1 - beta) * chance[:a]
    return _flat(b, np.where(k < 2, b.mean(), chance * size))


def seasonal_naive(b: Block) -> Fit:
    last, _, there = b.late(7)  # the newest first
    span = np.clip(b.n, 1, 7)
    ahead = lambda h: np.take_along_axis(last, span - 1 - np.arange(h)[:, None] % span, 0)
    return Fit(ahead, lambda: np.concatenate([b.y[:7], b.y[:-7]])[: len(b.y)], b.n > 0)


MODELS = {"moving_avg": moving_average, "linear_seasonal": linear_seasonal, "holt_winters": holt_winters, "croston": croston, "sba": sba, "tsb": tsb}
NAMES, STEADY = list(MODELS), 3  # those behind the third are for sporadic sales alone
LONGEST = 42  # days of the longest back-test


def half_up(x: np.ndarray) -> np.ndarray:
    """Whole numbers, half upwards, of x to six decimals: a half is a half whatever the order of the sums that led to it."""
    return np.floor(np.round(x, 6) + 0.5)


def one(x: np.ndarray) -> np.ndarray:
    """One decimal, half away from zero, as ``half_up``."""
    return np.sign(x) * half_up(np.abs(x) * 10) / 10


@dataclass
class Choice:
    """By product: the model's number, then by model and product WAPE, MAPE and bias (nan: none), and where it could be had."""

    best: np.ndarray
    wape: np.ndarray
    mape: np.ndarray
    bias: np.ndarray
    ok: np.ndarray
    sporadic: np.ndarray


def choose(b: Block) -> Choice:
    """Back-test all models on the last days and take the lowest WAPE, the first of equals.

    Sporadic products are compared by weeks, and with the models for them too.
    """
    sold = ((b.y > 0) & b.there).sum(0)
    sporadic = (sold == 0) | (b.n / np.maximum(sold, 1) >= 1.32)
    test = np.clip(np.floor(b.n * 0.2 + 0.5), 14, LONGEST).astype(int)
    train = b.until(np.maximum(b.n - test, 0))
    j = np.arange(LONGEST)[:, None]
    held = j < test
    real = np.where(held, np.take_along_axis(b.y, np.clip(train.n + j, 0, len(b.y) - 1), 0), 0.0)
    weeks = lambda x: np.concatenate([x.reshape(LONGEST // 7, 7, -1).sum(1), np.zeros((LONGEST - LONGEST // 7, x.shape[1]))])
    real = np.where(sporadic, weeks(real), real)
    total, positive = real.sum(0), real > 0
    shape = (len(MODELS), len(b.n))
    wape, mape, bias, ok = np.full(shape, np.nan), np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape, bool)
    for m, (name, model) in enumerate(MODELS.items()):
        fit = model(train)
        ok[m] = b.n >= (21 if name == "holt_winters" else 1)
        use = fit.ok & (train.n >= 14) & (total > 0) & (sporadic | (m < STEADY))
        guess = np.where(held, fit.ahead(LONGEST), 0.0)
        guess = np.where(sporadic, weeks(guess), guess)
        off = np.abs(guess - real)
        with np.errstate(divide="ignore", invalid="ignore"):
            wape[m] = np.where(use, one(off.sum(0) / total * 100), np.nan)
            mape[m] = np.where(use & positive.any(0), one(np.where(positive, off / real, 0.0).sum(0) / positive.sum(0) * 100), np.nan)
            bias[m] = np.where(use, one((guess - real).sum(0) / total * 100), np.nan)
    tried = np.where(np.isnan(wape), np.inf, wape)
    best = np.where(np.isfinite(tried).any(0), tried.argmin(0), np.where(sporadic, NAMES.index("croston"), NAMES.index("moving_avg")))
    return Choice(best, wape, mape, bias, ok, sporadic)


SCHEMA = "product_id string, date date, actual double, forecast double, lower double, upper double, is_future boolean, model string, wape double, mape double, bias double, days int"


def by_product(series: DataFrame, lookback: int) -> DataFrame:
    """(product_id, days, units): a row a product with its recent days (as numbers) and sales, dealt evenly to tasks; the series is read once.

    The number of tasks is asked for outright, as the rows are few bytes beside the work that they make. Of rows that
    repeat a day the largest counts.
    """
    once = series.groupBy(F.col("product_id").cast("string").alias("product_id"), F.unix_date("date").alias("day")).agg(F.max("units").cast("double").alias("units"))
    rows = once.groupBy("product_id").agg(F.max("day").alias("top"), F.collect_list(F.struct("day", "units")).alias("s"))  # a product has no more rows than there are days
    rows = rows.withColumn("s", F.filter("s", lambda x: x["day"] >= F.col("top") - lookback))
    rows = written(rows.select("product_id", F.col("s.day").alias("days"), F.col("s.units").alias("units")), "series")
    n = rows.count()
    return rows.repartition(max(1, -(-n // BLOCK), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 8))))


def blocks(batches: Iterable[pa.RecordBatch], drop_last: bool, lookback: int, least: int = 14) -> Iterator[tuple[Block, list[str], np.ndarray]]:
    """(block, product_ids, number of each product's first day) of the products with ``least`` days or more."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            ids, days, units = part.column(0).to_pylist(), part.column(1), part.column(2)
            owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(days.offsets)))
            day, sold = np.asarray(days.flatten()).astype(np.int64), np.nan_to_num(np.asarray(units.flatten(), float))
            first, last = np.full(part.num_rows, 1 << 40), np.full(part.num_rows, -(1 << 40))
            np.minimum.at(first, owner, day)
            np.maximum.at(last, owner, day)
            n = last - first + 1
            if drop_last:
                n = np.where(n > 1, n - 1, n)
            first = first + np.maximum(n - lookback, 0)
            n = np.minimum(n, lookback)
            order = np.argsort(-n, kind="stable")
            order = order[n[order] >= least]
            if not len(order):
                continue
            place = np.full(part.num_rows, -1)
            place[order] = np.arange(len(order))
            y = np.zeros((int(n[order[0]]), len(order)))
            row, column = day - first[owner], place[owner]
            use = (column >= 0) & (row >= 0) & (row < n[owner])
            y[row[use], column[use]] = sold[use]
            start = first[order]
            yield Block(y, n[order], (start + 4) % 7), [ids[i] for i in order], start  # day 0 was a Thursday


def auto_forecast(series: DataFrame, horizon: int = 30, drop_last: bool = True, lookback: int = 540) -> DataFrame:
    """Points of every product with at least 14 days: history as fitted and ``horizon`` days ahead, with an 80 % band.

    ``series`` has (product_id, date, units); the last, unfinished day is dropped.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, start in blocks(batches, drop_last, lookback):
            choice = choose(b)
            for m in np.unique(choice.best):
                mine = np.flatnonzero(choice.best == m)
                part = b.of(mine)
                fit = MODELS[NAMES[m]](part)
                past, next_ = fit.past(), fit.ahead(horizon)
                at = part.n - 1 - np.arange(90)[:, None]
                rest = np.take_along_axis(part.y - past, np.maximum(at, 0), 0)
                k = np.minimum(part.n, 90)
                mean = np.where(at >= 0, rest, 0.0).sum(0) / k
                band = 1.28 * np.where(k > 1, np.sqrt((np.where(at >= 0, rest - mean, 0.0) ** 2).sum(0) / np.maximum(k - 1, 1)), 0.0)
                days = np.arange(len(past) + horizon)[:, None]
                future = (days >= part.n).T
                there = (days < part.n + horizon).T
                value = np.zeros((len(days), len(mine)))
                value[: len(past)] = past
                np.put_along_axis(value, _coming(part, horizon), next_, 0)
                actual = np.zeros(value.shape)
                actual[: len(past)] = part.y
                flat = lambda x: np.broadcast_to(x, there.shape)[there]  # noqa: E731  product by product
                facts = [np.array([getattr(choice, f)[m, p] for p in mine])[:, None] for f in ("wape", "mape", "bias")]
                owner = flat(np.arange(len(mine))[:, None])
                columns = [
                    pa.array([ids[i] for i in mine]).take(pa.array(owner)), pa.array(flat(start[mine][:, None] + days.T), pa.int32()).cast(pa.date32()), pa.array(flat(actual.T), mask=flat(future)), *(pa.array(flat(half_up(v).T)) for v in (value, np.maximum(value - band, 0), value + band)),
                    pa.array(flat(future)), pa.array([NAMES[m]] * len(owner)), *(pa.array(flat(f), mask=np.isnan(flat(f))) for f in facts), pa.array(flat(part.n[:, None]), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return by_product(series, lookback).mapInArrow(work, SCHEMA)


TOTALS = "product_id string, model string, wape double, forecast_sum double"


def forecast_totals(series: DataFrame, horizon: int = 30, drop_last: bool = True, lookback: int = 540) -> DataFrame:
    """What ``forecast_sums`` makes of ``auto_forecast``, without the points."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, _ in blocks(batches, drop_last, lookback):
            choice = choose(b)
            total = np.zeros(len(ids))
            for m in np.unique(choice.best):
                mine = choice.best == m
                total[mine] = half_up(MODELS[NAMES[m]](b.of(mine)).ahead(horizon)).sum(0)
            wape = choice.wape[choice.best, np.arange(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([NAMES[m] for m in choice.best]), pa.array(wape, mask=np.isnan(wape)), pa.array(total)], ["product_id", "model", "wape", "forecast_sum"])

    return by_product(series, lookback).mapInArrow(work, TOTALS)


CANDIDATES = "product_id string, model string, wape double, eligible boolean, rank int, chosen boolean"


def candidates(series: DataFrame, drop_last: bool = True, lookback: int = 540) -> DataFrame:
    """The models that ``auto_forecast`` tries for each product, the best back-test first, those without one last."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, _ in blocks(batches, drop_last, lookback):
            choice = choose(b)
            order = np.argsort(np.where(np.isnan(choice.wape), np.inf, choice.wape), axis=0, kind="stable")
            rows = []
            for p, name in enumerate(ids):
                mine = [m for m in order[:, p] if choice.sporadic[p] or m < STEADY]
                rows += [(name, NAMES[m], None if np.isnan(choice.wape[m, p]) else float(choice.wape[m, p]), bool(choice.ok[m, p]), k, bool(m == choice.best[p])) for k, m in enumerate(mine, 1)]
            kinds = (pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in CANDIDATES.split(", ")])

    return by_product(series, lookback).mapInArrow(work, CANDIDATES)


def forecast_sums(points: DataFrame) -> DataFrame:
    """(product_id, model, wape, forecast_sum)."""
    return points.groupBy("product_id").agg(F.max("model").alias("model"), F.max("wape").alias("wape"), F.sum(F.when(F.col("is_future"), F.col("forecast"))).alias("forecast_sum"))


def env_regression(weeks: DataFrame, kinds: DataFrame | None = None, factors: tuple[str, ...] = ("pm2_5", "temp_mean", "precip")) -> DataFrame:
    """Weekly units on trend and weather, standardised: one row a product and term.

    ``weeks`` has (product_id, week, units, and a mean of each factor), from products with at least 56 dense days.
    Weeks without particulates or temperature are left out, missing rain is 0, ten weeks are needed. With ``kinds``
    (product_id, kind) a product's weather terms are those that may bear on its kind, for some kinds none but the trend;
    without, all ``factors`` are. A term counts from |t| of 2 on; its impact is high from a beta of 0.3, medium from
    0.15, and none where it doesn't count. Products with a singular system are left out.

    The weeks are summed to one tableau of correlations a product, combined before the shuffle. One elimination a term
    (the sweep) turns it into the coefficients, the inverse and what is left of the variance; terms that don't bear on a
    product's kind stand apart with a correlation of 0.
    """
    terms = ["trend", *factors]
    k, size = len(terms), len(terms) + 1
    values = [F.col("week").cast("double"), *(F.coalesce(F.col(f), F.lit(0.0)) if f == "precip" else F.col(f) for f in factors), F.col("units")]
    rows = weeks.filter("pm2_5 is not null and temp_mean is not null")
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = rows.groupBy("product_id").agg(F.count("*").alias("n"), *(F.covar_samp(values[i], values[j]).alias(f"c{i}_{j}") for i, j in pairs)).filter("n >= 10")
    if kinds is None:
        sums = sums.withColumn("own", F.array(*map(F.lit, factors)).cast("array<string>"))
    else:
        sums = sums.join(kinds.select("product_id", weather_factors(F.col("kind")).alias("own")), "product_id")

    def cell(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        own = [F.lit(True) if x in (0, k) else F.array_contains("own", terms[x]) for x in (i, j)]
        spread = [F.col(f"c{x}_{x}") for x in (i, j)]
        if i == j:
            return F.when(~own[0] | (spread[0] > 0), 1.0).otherwise(0.0)
        return F.when(own[0] & own[1] & (spread[0] > 0) & (spread[1] > 0), F.col(f"c{i}_{j}") / F.sqrt(spread[0] * spread[1])).otherwise(0.0)

    def at(m: Column, i: Column | int, j: Column | int) -> Column:
        return F.get(m, i * size + j)

    def sweep(m: Column, p: Column) -> Column:
        pivot = F.when(at(m, p, p) > 1e-10, at(m, p, p))  # null for a singular system, and so is all that follows

        def turned(t: Column) -> Column:
            i, j = F.floor(t / size).cast("int"), t % size
            return (
                F.when((i == p) & (j == p), 1 / pivot).when(j == p, -at(m, i, p) / pivot).when(i == p, at(m, p, j) / pivot)
                .otherwise(at(m, i, j) - at(m, i, p) * at(m, p, j) / pivot)
            )

        return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), turned)

    start = F.array(*(cell(i, j) for i in range(size) for j in range(size)))
    solved = sums.select("product_id", "n", "own", cell(k, k).alias("whole"), (F.size("own") + 2).alias("k"), F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, sweep).alias("m"))
    solved = solved.withColumn("rest", at(F.col("m"), k, k)).filter("rest is not null and n > k + 1")
    each = F.array(*(F.struct(F.lit(t).alias("factor"), at(F.col("m"), i, k).alias("b"), at(F.col("m"), i, i).alias("inverse")) for i, t in enumerate(terms)))
    each = F.filter(each, lambda x: (x["factor"] == "trend") | F.array_contains("own", x["factor"]))
    out = solved.select("*", F.inline(each)).withColumn("ratio", F.when(F.col("rest") * F.col("inverse") > 0, F.col("b") / F.sqrt(F.col("rest") * F.col("inverse") / (F.col("n") - F.col("k")))).otherwise(0.0))
    counts, r2 = (F.abs("ratio") >= 2) & (F.col("n") - F.col("k") >= 3), F.greatest(F.lit(0.0), 1 - F.col("rest"))
    share = lambda x: F.when(F.col("whole") > 0, rounded(x, 3)).otherwise(0.0)
    return out.select(
        F.col("product_id").cast("string").alias("product_id"), "factor", (rounded(F.col("b"), 2) + 0.0).alias("beta"), (rounded(F.col("ratio"), 1) + 0.0).alias("t"), counts.alias("significant"),
        F.when(~counts, "none").when(F.abs("b") >= 0.3, "high").when(F.abs("b") >= 0.15, "medium").otherwise("low").alias("impact"), F.when(F.col("b") >= 0, "up").otherwise("down").alias("direction"), (F.size("own") > 0).alias("weather_relevant"),
        share(r2).alias("r2"), share(F.greatest(F.lit(0.0), 1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - F.col("k")))).alias("adj_r2"), F.col("n").cast("int").alias("n"),
    )


def env_weeks(dense: DataFrame, env: DataFrame, least: int = 56) -> DataFrame:
    """Weekly sums of units beside the weekly means of the weather."""
    from pyspark.sql import Window

    whole = Window.partitionBy("product_id")
    rows = dense.withColumns({"first": F.min("date").over(whole), "n": F.count("*").over(whole)}).filter(F.col("n") >= least)
    rows = rows.join(F.broadcast(env), "date", "left").withColumn("week", F.floor(F.datediff("date", "first") / 7).cast("int"))  # env: one row a day
    return rows.groupBy("product_id", "week").agg(F.sum("units").alias("units"), F.avg("pm2_5").alias("pm2_5"), F.avg("temp_mean").alias("temp_mean"), F.avg("precip").alias("precip"))
