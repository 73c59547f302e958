"""Forecast jobs; those without SQL are compared with plain loops in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions.numeric import rounded
from marketlens.functions.rules import WEATHER_FACTORS
from marketlens.operators import ml, models
from marketlens.operators import reviews as rv
from marketlens.operators import sales as sl
from marketlens.operators import sales_forecast as sf
from marketlens.operators import series as se
from marketlens.plans import forecast_sql as fsql
from marketlens.plans.inventory import AS_OF, CORR, EM, LEAD, MONTHS, TIER, _mood
from marketlens.plans.reviews import DAYS, labelled
from marketlens.plans.sql import sql
from marketlens.sources import fixtures as fx
from marketlens.sources.scratch import written


def _daily(s, d):
    return sl.gmv_scopes(fx.sales(s, d), fx.financials(s, d)).select("scope", "date", "gmv")


def _points(s, d):
    return models.auto_forecast(fx.brand_daily(s, d))


def _weeks(s, d):
    return models.env_weeks(se.densify(fx.brand_daily(s, d)), fx.env_daily(s, d))


def _quality(s, d):
    """A seasonal-naive forecast, a week behind, against what was sold."""
    from pyspark.sql import Window

    week = Window.partitionBy("product_id").orderBy("date")
    dense = se.densify(fx.brand_daily(s, d))
    return se.forecast_quality(dense.select("product_id", F.col("units").alias("actual"), F.lag("units", 7).over(week).alias("forecast")).filter("forecast is not null"))


def _kinds(s, d):
    """(product_id, kind) of brands, a kind by the number in the name."""
    kinds = F.array(*map(F.lit, WEATHER_FACTORS))
    return fx.table(s, d, "part").select(F.col("p_brand").alias("product_id")).distinct().withColumn("kind", F.element_at(kinds, (F.substring("product_id", 7, 2).cast("int") % len(WEATHER_FACTORS) + 1)))


def _trends(s, d):
    rows = written(labelled(s, d).select("comment_id", "created_at", "brand", "product_name", "rating", "sentiment", "category", "urgent"), "trend-labels")  # labelled once
    parts = {by: rv.daily_trend(rows, by=by, praise=fx.LEXICON.praise) for by in (None, "brand", "category")}
    return rv.trend_insights(parts[None], parts["brand"], parts["category"], rv.product_stats(rows, fx.products(s, d)), DAYS)


def _why(s, d):
    months = written(se.monthly_forecast(fx.brand_daily(s, d)), "months")
    return se.why_this_month(months, se.env_drivers(months, sl.env_monthly(fx.env_daily(s, d))))


def _product_360(s, d):
    """The facts of a product's page, all products at once; daily sales, their dense series and the forecast are written once."""
    daily, stock, env = written(fx.brand_daily(s, d), "daily"), written(fx.brand_stock(s, d), "stock"), written(fx.env_daily(s, d), "env")
    dense, future = written(se.densify(daily), "dense"), written(models.auto_forecast(daily), "forecast")
    points = future.filter("is_future").select("product_id", "date", F.col("forecast").alias("units"))
    months = written(se.monthly_forecast(daily), "months")
    as_of = F.lit(AS_OF).cast("date")
    mood = se.sentiment_signals(daily, _mood(s, d)).filter("strength <> 'low'").groupBy("product_id").agg(F.max_by("signal", F.struct(F.abs("corr"), "signal")).alias("leading_signal"))
    out = se.demand_pattern(dense).select("product_id", "pattern")
    for part in (
        se.lifecycle_stage(daily).select("product_id", "stage"),
        se.price_elasticity(daily).select("product_id", "elasticity", "sensitivity"),
        models.forecast_sums(future),
        sl.stock_metrics(sl.product_catalog(daily, stock, as_of), LEAD).select("product_id", "daily_rate", "days_of_cover"),
        se.reorder_plan(se.stock_science(dense, stock, LEAD), stock, LEAD).select("product_id", "cover", "status", "order_qty"),
        se.reconstruction_summary(se.reconstruct_demand(dense)).select("product_id", "uplift_pct"),
        se.lost_sales(points, stock, LEAD, sl.average_price(daily)).select("product_id", "lost_units", "level"),
        se.why_this_month(months, se.env_drivers(months, sl.env_monthly(env))).select("product_id", "diff_pct", "top_factor"),
        models.env_regression(models.env_weeks(dense, env), _kinds(s, d)).filter("factor = 'trend'").select("product_id", F.col("beta").alias("trend_beta"), "adj_r2"),
        mood,
    ):
        out = out.join(part, "product_id", "left")
    return out


WEEKS = """, w AS (SELECT dense.product_id, (date - first) // 7 AS week, units, pm2_5, temp_mean, precip FROM dense JOIN (SELECT product_id, min(date) AS first FROM dense GROUP BY 1 HAVING count(*) >= 56) USING (product_id) LEFT JOIN env USING (date))
SELECT product_id, CAST(week AS INTEGER) AS week, sum(units) AS units, round(avg(pm2_5), 3) AS pm2_5, round(avg(temp_mean), 3) AS temp_mean, round(avg(precip), 3) AS precip FROM w GROUP BY 1, 2"""

TRENDS = f""", mx AS (SELECT max(date) AS t FROM dt), p AS (SELECT dt.*, t - date < {DAYS} AS now FROM dt, mx WHERE t - date < {2 * DAYS}),
  pr AS (SELECT now, CAST(sum(total) AS BIGINT) AS total, round(CAST(sum(positive) - sum(negative) AS DOUBLE) / sum(total) * 100, 1) AS score FROM p GROUP BY 1),
  pa AS (SELECT max(score) FILTER (now) AS s1, max(score) FILTER (NOT now) AS s0, max(total) FILTER (now) AS t1, max(total) FILTER (NOT now) AS t0 FROM pr),
  bq AS (SELECT brand, sum(total) FILTER (back < {DAYS}) AS n1, sum(total) FILTER (back >= {DAYS}) AS n0, sum(sentiment_score * total) FILTER (back < {DAYS}) AS w1, sum(sentiment_score * total) FILTER (back >= {DAYS}) AS w0
    FROM (SELECT *, (SELECT max(date) FROM dbt) - date AS back FROM dbt) WHERE back < {2 * DAYS} GROUP BY 1 HAVING n1 >= 10 AND n0 >= 10),
  mv AS (SELECT brand, round(w0 / n0, 1) AS previous, round(round(w1 / n1, 1) - round(w0 / n0, 1), 1) AS change FROM bq),
  ca AS (SELECT category, coalesce(sum(dct.total) FILTER (t - date < {DAYS}), 0) AS now, coalesce(sum(dct.total) FILTER (t - date >= {DAYS}), 0) AS was FROM dct, mx WHERE t - date < {2 * DAYS} GROUP BY 1 HAVING now > 0),
  cr AS (SELECT *, CASE WHEN was > 0 THEN floor(CAST(now - was AS DOUBLE) / was * 100 + 0.5) WHEN now >= 5 THEN 999 ELSE 0 END AS rise FROM ca),
  re AS (SELECT * FROM p WHERE now), st AS (SELECT avg(urgent_count) AS m, stddev_pop(urgent_count) AS sd, count(*) AS n FROM re), fu AS (SELECT * FROM re WHERE total >= 3)
SELECT 'score' AS kind, NULL AS subject, round(s1 - s0, 1) AS value, s0 AS before FROM pa WHERE abs(round(s1 - s0, 1)) >= 1
UNION ALL SELECT 'volume', NULL, floor(CAST(t1 - t0 AS DOUBLE) / t0 * 100 + 0.5), CAST(t0 AS DOUBLE) FROM pa WHERE abs(floor(CAST(t1 - t0 AS DOUBLE) / t0 * 100 + 0.5)) >= 15
UNION ALL SELECT 'worst_brand', brand, change, previous FROM (SELECT * FROM mv ORDER BY change, brand LIMIT 1) WHERE change <= -3
UNION ALL SELECT 'best_brand', brand, change, previous FROM (SELECT * FROM mv ORDER BY change DESC, brand LIMIT 1) WHERE change >= 3
UNION ALL SELECT 'rising_category', category, rise, CAST(was AS DOUBLE) FROM (SELECT * FROM cr WHERE now >= 5 ORDER BY rise DESC, category LIMIT 1) WHERE rise >= 25
UNION ALL SELECT 'top_category', category, CAST(now AS DOUBLE), CAST(was AS DOUBLE) FROM (SELECT * FROM ca ORDER BY now DESC, category LIMIT 1)
UNION ALL SELECT 'product', product_name, sentiment_score, CAST(urgent_count AS DOUBLE) FROM (SELECT * FROM ps WHERE total >= 3 ORDER BY urgent_count DESC, sentiment_score, product_name LIMIT 1) WHERE urgent_count > 0 OR sentiment_score < 0
UNION ALL SELECT 'urgent_spike', CAST(date AS VARCHAR), CAST(urgent_count AS DOUBLE), round(m, 2) FROM (SELECT * FROM re ORDER BY urgent_count DESC, date LIMIT 1), st WHERE n >= 4 AND sd > 0 AND urgent_count > m + 2 * sd AND urgent_count >= 3
UNION ALL SELECT 'best_day', CAST(date AS VARCHAR), sentiment_score, NULL FROM (SELECT * FROM fu ORDER BY sentiment_score DESC, date LIMIT 1) WHERE (SELECT count(*) FROM fu) >= 2
UNION ALL SELECT 'worst_day', CAST(date AS VARCHAR), sentiment_score, NULL FROM (SELECT * FROM fu ORDER BY sentiment_score, date LIMIT 1) WHERE (SELECT count(*) FROM fu) >= 2"""
WHY = (
    MONTHS
    + f""", em AS ({EM}), lo AS (SELECT product_id, mf.units, factor, v FROM mf JOIN em USING (month) CROSS JOIN LATERAL (VALUES ('pm2_5', pm2_5), ('temp_mean', temp_mean), ('precip', precip)) z(factor, v) WHERE NOT is_forecast),
  c AS (SELECT product_id, factor, round({CORR.format(x="units", y="v")}, 2) AS corr FROM lo GROUP BY 1, 2 HAVING count(*) >= 4 AND count(v) = count(*)),
  tf AS (SELECT product_id, factor AS top_factor FROM c WHERE abs(corr) >= 0.35 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY abs(corr) DESC, factor DESC) = 1),
  r AS (SELECT *, avg(units) OVER (PARTITION BY product_id ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS av, row_number() OVER (PARTITION BY product_id ORDER BY month) AS k, count(*) OVER (PARTITION BY product_id) AS al FROM mf WHERE NOT is_forecast)
SELECT r.product_id, month, units, floor((units - av) / av * 100 + 0.5) AS diff_pct, top_factor FROM r LEFT JOIN tf ON tf.product_id = r.product_id WHERE k = al AND al >= 4 AND av > 0"""
)
QUALITY = """, p AS (SELECT product_id, units AS actual, lag(units, 7) OVER (PARTITION BY product_id ORDER BY date) AS forecast FROM dense),
  e AS (SELECT *, forecast - actual AS e FROM p WHERE forecast IS NOT NULL),
  q AS (SELECT product_id, count(*) AS n, CASE WHEN sum(actual) > 0 THEN round(sum(abs(e)) / sum(actual) * 100, 1) ELSE 0 END AS wape, round(avg(abs(e) / actual) FILTER (actual > 0) * 100, 1) AS mape, CASE WHEN sum(actual) > 0 THEN round(sum(e) / sum(actual) * 100, 1) ELSE 0 END AS bias, round(sqrt(avg(e * e)), 1) AS rmse FROM e GROUP BY 1 HAVING count(*) >= 7)
SELECT *, CASE WHEN wape <= 20 THEN 'high' WHEN wape <= 35 THEN 'good' WHEN wape <= 50 THEN 'fair' ELSE 'caution' END AS grade FROM q"""


def _forecast_sql(horizon: int) -> str:
    """Forecast of sales by scope, step by step: dense days, campaign days, trend, weekday shape, uplift, band, points (``po``)."""
    return f""", sd AS (SELECT 'ALL' AS scope, date, CAST(sum(gmv) AS DOUBLE) AS gmv FROM sales GROUP BY 2 UNION ALL SELECT 'platform:' || platform, date, CAST(sum(gmv) AS DOUBLE) FROM sales GROUP BY 1, 2 UNION ALL SELECT 'brand:' || brand, date, CAST(sum(gmv) AS DOUBLE) FROM sales GROUP BY 1, 2),
  sg AS (SELECT scope, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sd GROUP BY 1),
  s0 AS (SELECT sg.scope, sg.date, coalesce(gmv, 0) AS gmv, row_number() OVER (PARTITION BY sg.scope ORDER BY sg.date) - 1 AS i, count(*) OVER (PARTITION BY sg.scope) AS al FROM sg LEFT JOIN sd ON sd.scope = sg.scope AND sd.date = sg.date),
  s1 AS (SELECT scope, date, gmv, i, count(*) OVER (PARTITION BY scope) AS n, quantile_cont(CASE WHEN gmv > 0 THEN gmv END, 0.5) OVER (PARTITION BY scope ORDER BY date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS md FROM s0 WHERE i < al - 1 OR al = 1),
  ba AS (SELECT scope, date, gmv, i, n, dayofweek(date) + 1 AS dow, coalesce(gmv > 1.6::DOUBLE * md, FALSE) AS camp, {TIER} AS tier FROM s1),
  us AS (SELECT *, NOT camp AND gmv > 0 AND i >= n - 180 AS use FROM ba),
  l0 AS (SELECT scope, coalesce(covar_pop(gmv, i) FILTER (use) / nullif(var_pop(i) FILTER (use), 0), 0) AS slope, coalesce(avg(i) FILTER (use), 0) AS mx, coalesce(avg(gmv) FILTER (use), 0) AS my, max(n) AS n, max(date) AS last FROM us GROUP BY 1),
  li AS (SELECT scope, slope, n, last, my - slope * mx AS start FROM l0),
  rt AS (SELECT us.*, greatest(0, start + slope * i) AS t FROM us JOIN li USING (scope)),
  se AS (SELECT scope, dow, quantile_cont(gmv / t, 0.5) AS w FROM rt WHERE NOT camp AND gmv > 0 AND i >= n - 365 AND t > 0 GROUP BY 1, 2),
  gi AS (SELECT scope, dow, w / avg(w) OVER (PARTITION BY scope) AS w FROM (SELECT li.scope, g.dow, coalesce(w, 1) AS w FROM li CROSS JOIN (SELECT unnest(range(1, 8)) AS dow) g LEFT JOIN se ON se.scope = li.scope AND se.dow = g.dow)),
  ro AS (SELECT rt.*, t * w AS base FROM rt JOIN gi USING (scope, dow)),
  up AS (SELECT scope, tier, CASE WHEN n >= 2 AND m >= 1.1 THEN m ELSE 1 END AS multiple FROM (SELECT scope, tier, count(*) AS n, quantile_cont(gmv / base, 0.5) AS m FROM ro WHERE tier IS NOT NULL AND gmv > 0 AND base > 0 GROUP BY 1, 2)),
  bd_ AS (SELECT scope, 1.5 * sqrt(coalesce(avg((gmv - base) * (gmv - base)) FILTER (use), 0)) AS band FROM ro GROUP BY 1),
  ah AS (SELECT a.scope, a.date, greatest(0, start + slope * (n - 1 + h)) * w AS base, {TIER} AS tier FROM (SELECT li.*, h, CAST(last + CAST(h AS INTEGER) AS DATE) AS date FROM li CROSS JOIN (SELECT unnest(range(1, {horizon + 1})) AS h)) a JOIN gi ON gi.scope = a.scope AND gi.dow = dayofweek(a.date) + 1),
  pt AS (SELECT scope, date, gmv AS actual, base, tier, FALSE AS is_future, camp FROM ro UNION ALL SELECT scope, date, NULL, base, tier, TRUE, FALSE FROM ah),
  po AS (SELECT pt.scope, date, actual, round(base) AS baseline, round(base * coalesce(multiple, 1)) AS forecast, round(greatest(0, base * coalesce(multiple, 1) - band)) AS lower, round(base * coalesce(multiple, 1) + band) AS upper,
    CASE WHEN is_future THEN coalesce(multiple, 1) > 1 ELSE camp END AS is_campaign, pt.tier, is_future FROM pt LEFT JOIN up ON up.scope = pt.scope AND up.tier = pt.tier JOIN bd_ ON bd_.scope = pt.scope) """


FACTS = """, ow AS (SELECT scope, max(date) AS last, coalesce(sum(gmv) FILTER (i >= n - 30), 0) AS last30, coalesce(sum(gmv) FILTER (i >= n - 60 AND i < n - 30), 0) AS prev30, round(least(100, avg(CASE WHEN i >= n - 30 AND NOT camp AND gmv > 0 THEN abs(base - gmv) / gmv END) * 100), 1) AS mape, CAST(count(*) AS INTEGER) AS days, count(*) FILTER (camp) AS campaign_days FROM ro GROUP BY 1),
  ye AS (SELECT a.scope, sum(a.gmv) AS now, sum(b.gmv) AS was FROM ro a LEFT JOIN ro b ON b.scope = a.scope AND b.date = a.date - 365 WHERE a.i >= a.n - 30 GROUP BY 1),
  mo AS (SELECT po.scope, coalesce(sum(actual) FILTER (NOT is_future), 0) AS mtd, coalesce(sum(forecast) FILTER (is_future), 0) AS rest FROM po JOIN ow USING (scope) WHERE date_trunc('month', date) = date_trunc('month', last) GROUP BY 1),
  nx AS (SELECT scope, sum(forecast) AS forecast_ahead FROM po WHERE is_future GROUP BY 1)
SELECT ow.scope, days, campaign_days, round(last30) AS last30, round(prev30) AS prev30, coalesce(round((last30 - prev30) / nullif(prev30, 0) * 100, 1), 0) AS mom_pct, round((now - was) / nullif(was, 0) * 100, 1) AS yoy_pct, forecast_ahead, round(mtd) AS month_to_date, round(mtd + rest) AS month_end, mape
FROM ow JOIN ye USING (scope) JOIN mo USING (scope) JOIN nx USING (scope)"""
UPLIFT = """, f AS (SELECT *, CAST(date - min(date) OVER (PARTITION BY scope) + 1 AS INTEGER) AS days_away FROM po WHERE is_future)
SELECT scope, date, tier, days_away, baseline, forecast AS projected, CASE WHEN baseline > 0 THEN CAST(floor((forecast - baseline) / baseline * 100 + 0.5) AS BIGINT) ELSE 0 END AS uplift_pct, forecast - baseline AS extra_gmv, tier IN ('mega', 'major', 'cny', 'songkran', 'newyear') AS is_big FROM f WHERE tier IS NOT NULL"""

PARTS_DAILY = """, px AS (SELECT max(date) AS t FROM sales), pq AS (SELECT DISTINCT product_id FROM sales, px WHERE units > 0 AND date >= t - 90 AND product_id IS NOT NULL),
  pd AS (SELECT product_id, date, CAST(sum(units) AS DOUBLE) AS units FROM sales, px WHERE units > 0 AND date >= t - 540 AND product_id IN (SELECT product_id FROM pq) GROUP BY 1, 2)"""

JOBS = {
    "auto_forecast": (_points, fsql.recursive(sql(fsql.POINTS.replace("{}", "bd"), "bd"))),
    "part_forecast": (lambda s, d: models.forecast_totals(sl.product_demand(fx.sales(s, d))), fsql.recursive(sql(PARTS_DAILY + fsql.TOTALS.replace("{}", "pd"), "sales"))),
    "forecast_candidates": (lambda s, d: models.candidates(fx.brand_daily(s, d)), fsql.recursive(sql(fsql.CANDIDATES.replace("{}", "bd"), "bd"))),
    "forecast_quality": (_quality, sql(QUALITY, "dense")),
    "trend_insights": (_trends, sql(TRENDS, "dt", "dbt", "dct", "ps")),
    "env_weeks": (lambda s, d: _weeks(s, d).select("product_id", "week", "units", *(rounded(F.col(c), 3).alias(c) for c in ("pm2_5", "temp_mean", "precip"))), sql(WEEKS, "dense", "env")),
    "env_regression": (lambda s, d: models.env_regression(_weeks(s, d), _kinds(s, d)), sql(fsql.REGRESSION, "dense", "env")),
    "why_this_month": (_why, sql(WHY, "bd", "env")),
    "sales_forecast": (lambda s, d: sf.sales_forecast(_daily(s, d))["points"], sql(_forecast_sql(30) + "SELECT * FROM po", "sales")),
    "sales_forecast_facts": (lambda s, d: sf.sales_forecast(_daily(s, d))["facts"], sql(_forecast_sql(30) + FACTS, "sales")),
    "campaign_uplift": (lambda s, d: sf.campaign_uplift(sf.sales_forecast(_daily(s, d), 120)["points"]), sql(_forecast_sql(120) + UPLIFT, "sales")),
    "ml_forecast": (lambda s, d: ml.ml_forecast(fx.brand_daily(s, d), 14)[0], None),
    "product_360": (_product_360, None),
}
