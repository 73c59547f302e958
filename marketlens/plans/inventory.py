"""Sales, demand and stock jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketlens.functions import calendar
from marketlens.operators import sales as sl
from marketlens.operators import series as se
from marketlens.plans.sql import sql
from marketlens.sources import fixtures as fx
from marketlens.sources import tables as tb

AS_OF = "2025-07-01"
LEAD = 14


def _dense(s, d):
    return se.densify(fx.brand_daily(s, d))


def _catalog(s, d):
    return sl.product_catalog(fx.brand_daily(s, d), fx.brand_stock(s, d), F.lit(AS_OF).cast("date"))


CATALOG = f"""SELECT r.product_id, units_30, units_90, round(units_30 / 30, 3) AS avg_daily_30, round(units_90 / 90, 3) AS avg_daily_90, stock FROM
  (SELECT product_id, sum(CASE WHEN date >= DATE '{AS_OF}' - 30 THEN units ELSE 0 END) AS units_30, sum(CASE WHEN date >= DATE '{AS_OF}' - 90 THEN units ELSE 0 END) AS units_90 FROM bd GROUP BY 1) r LEFT JOIN bs USING (product_id)"""
METRICS = f""", cat AS ({CATALOG}), m AS (SELECT *, CASE WHEN avg_daily_30 > 0 THEN avg_daily_30 ELSE coalesce(avg_daily_90, 0) END AS rate FROM cat),
  c AS (SELECT *, CASE WHEN rate > 0 AND stock IS NOT NULL THEN CAST(floor(stock / rate + 0.5) AS INTEGER) END AS days_of_cover FROM m),
  met AS (SELECT product_id, round(rate, 2) AS daily_rate, days_of_cover, CASE WHEN stock IS NULL THEN 'nostock' WHEN rate <= 0 THEN CASE WHEN stock > 0 THEN 'dead' ELSE 'nostock' END
    WHEN days_of_cover <= {LEAD} THEN 'urgent' WHEN days_of_cover <= {2 * LEAD} THEN 'soon' WHEN days_of_cover >= 120 THEN 'overstock' ELSE 'ok' END AS status,
    CAST(ceil(rate * {LEAD} + rate * {LEAD} * 0.5::DOUBLE) AS INTEGER) AS reorder_point, CAST(greatest(0, ceil(rate * {LEAD + 30} - coalesce(stock, 0))) AS INTEGER) AS recommended_qty FROM c) """
SCIENCE = f""", late AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS r FROM dense),
  st AS (SELECT product_id, avg(units) AS m, coalesce(stddev_samp(units), 0) AS sd FROM late WHERE r <= 90 GROUP BY 1),
  z AS (SELECT * FROM (VALUES (90, 1.2816::DOUBLE), (95, 1.6449::DOUBLE), (99, 2.3263::DOUBLE)) v(service, z)),
  sc AS (SELECT product_id, service, CAST(ceil(z * sd * sqrt({LEAD}::DOUBLE)) AS INTEGER) AS safety, m, sd, stock, (stock - m * {LEAD}) / nullif(sd * sqrt({LEAD}::DOUBLE), 0) AS q FROM st LEFT JOIN bs USING (product_id) CROSS JOIN z),
  sq AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(q)) AS t FROM sc),
  sp AS (SELECT *, 0.3989423::DOUBLE * exp(-q * q / 2) * t * (0.3193815::DOUBLE + t * (-0.3565638::DOUBLE + t * (1.781478::DOUBLE + t * (-1.821256::DOUBLE + t * 1.330274::DOUBLE)))) AS tail FROM sq),
  sci AS (SELECT product_id, service, safety, CAST(ceil(m * {LEAD} + safety) AS INTEGER) AS reorder_point, round(m, 2) AS mean_daily, round(sd, 2) AS sigma_daily,
    round((1 - CASE WHEN q > 0 THEN 1 - tail ELSE tail END) * 100, 1) AS stockout_risk, CASE WHEN m > 0 AND sd / m > 1 THEN 99 WHEN m > 0 AND sd / m > 0.5 THEN 95 ELSE 90 END AS recommended_service FROM sp) """
MONTHS = """, ms AS (SELECT product_id, date_trunc('month', date) AS month, sum(units) AS units FROM bd GROUP BY 1, 2),
  sp AS (SELECT product_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM ms GROUP BY 1),
  dm AS (SELECT sp.product_id, CAST(sp.month AS DATE) AS month, coalesce(units, 0) AS units, row_number() OVER (PARTITION BY sp.product_id ORDER BY sp.month) - 1 AS i, count(*) OVER (PARTITION BY sp.product_id) AS al
    FROM sp LEFT JOIN ms ON ms.product_id = sp.product_id AND ms.month = sp.month),
  ba AS (SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM dm WHERE i < al - 1 OR al = 1),
  li AS (SELECT product_id, coalesce(covar_pop(units, i) / nullif(var_pop(i), 0), 0) AS slope, avg(i) AS mx, avg(units) AS my, max(n) AS n, max(month) AS last FROM ba WHERE i >= n - 12 GROUP BY 1),
  ln AS (SELECT *, my - slope * mx AS start FROM li),
  ra AS (SELECT product_id, month(month) AS moy, avg(units / t) AS ratio FROM (SELECT ba.*, greatest(0, start + slope * i) AS t FROM ba JOIN ln USING (product_id)) WHERE t > 0 AND units > 0 GROUP BY 1, 2),
  gr AS (SELECT product_id, moy, ratio / avg(ratio) OVER (PARTITION BY product_id) AS ratio FROM (SELECT ln.product_id, g.moy, coalesce(ratio, 1) AS ratio FROM ln CROSS JOIN (SELECT unnest(range(1, 13)) AS moy) g LEFT JOIN ra ON ra.product_id = ln.product_id AND ra.moy = g.moy)),
  mf AS (SELECT product_id, month, floor(units + 0.5) AS units, FALSE AS is_forecast FROM ba UNION ALL
    SELECT a.product_id, a.month, greatest(0, floor(greatest(0, start + slope * (n - 1 + h)) * ratio + 0.5)), TRUE
    FROM (SELECT ln.*, h, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS month FROM ln CROSS JOIN (SELECT unnest(range(1, 13)) AS h)) a JOIN gr ON gr.product_id = a.product_id AND gr.moy = month(a.month)) """
EM = "SELECT CAST(date_trunc('month', date) AS DATE) AS month, round(avg(pm2_5), 1) AS pm2_5, round(avg(temp_mean), 1) AS temp_mean, round(sum(precip), 1) AS precip FROM env GROUP BY 1"
TIER = """CASE WHEN month(date) = day(date) AND month(date) >= 11 THEN 'mega' WHEN abs(date - CASE year(date) WHEN 2024 THEN DATE '2024-02-10' WHEN 2025 THEN DATE '2025-01-29' WHEN 2026 THEN DATE '2026-02-17' WHEN 2027 THEN DATE '2027-02-06' WHEN 2028 THEN DATE '2028-01-26' END) <= 1 THEN 'cny'
  WHEN month(date) = day(date) AND month(date) >= 6 THEN 'major' WHEN month(date) = 4 AND day(date) BETWEEN 13 AND 15 THEN 'songkran' WHEN (month(date) = 12 AND day(date) = 31) OR (month(date) = 1 AND day(date) <= 2) THEN 'newyear'
  WHEN month(date) = day(date) THEN 'double' WHEN date = last_day(date) - CAST(greatest(isodow(last_day(date)) - 5, 0) AS INTEGER) THEN 'payday' WHEN day(date) = 15 THEN 'midmonth' END"""


def _prices(s, d):
    return sl.average_price(fx.brand_daily(s, d))


def _future(s, d):
    """Demand ahead: the last 30 days on record, moved on by 30 days."""
    daily = fx.brand_daily(s, d)
    return daily.filter(F.col("date") > F.date_sub(F.lit(AS_OF).cast("date"), 30)).filter(F.col("date") <= F.lit(AS_OF).cast("date")).select("product_id", F.date_add("date", 30).alias("date"), "units")


def _mood(s, d):
    """Reviews by product and day: comments of a brand's share of items."""
    rows = fx.table(s, d, "events").select((F.concat(F.lit("Brand#"), (F.col("event_id") % 25 + 1).cast("string"))).alias("product_id"), F.date_add(F.lit("2019-01-01").cast("date"), (F.col("event_id") * 7 % 2300).cast("int")).alias("date"), "value")
    return rows.groupBy("product_id", "date").agg(F.count("*").alias("n"), rounded_avg("value").alias("avg_rating"), F.max("value").alias("net"))


def rounded_avg(c):
    from marketlens.functions.numeric import rounded

    return rounded(F.avg(c), 2)


MOOD = "SELECT 'Brand#' || (event_id % 25 + 1) AS product_id, CAST(DATE '2019-01-01' + CAST(event_id * 7 % 2300 AS INTEGER) AS DATE) AS date, count(*) AS n, round(avg(value), 2) AS avg_rating, max(value) AS net FROM events GROUP BY 1, 2"
CORR = "CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) >= 4 THEN coalesce(covar_pop({x}, {y}) / nullif(sqrt(var_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * var_pop(CASE WHEN {x} IS NOT NULL THEN {y} END)), 0), 0) ELSE 0 END"
STRENGTH = "CASE WHEN abs(corr) >= 0.6 THEN 'high' WHEN abs(corr) >= 0.35 THEN 'medium' ELSE 'low' END"



def _merged_env(s, d):
    """Weather landed as JSON-like arrays, a month a row, from an archive with gaps, a forecast and hourly particulates."""
    env = fx.env_daily(s, d)
    text = F.date_format("date", "yyyy-MM-dd")

    def landed(rows, temp, rain):
        z = F.collect_list(F.struct(text.alias("time"), temp.alias("t"), rain.alias("p")))
        by_month = rows.groupBy(F.trunc("date", "MM")).agg(z.alias("z"))
        return by_month.select(F.struct(F.col("z.time").alias("time"), F.col("z.t").alias("temperature_2m_mean"), F.col("z.p").alias("precipitation_sum")).alias("daily"))

    archive = landed(env.filter(F.month("date") != 7), F.when(F.dayofmonth("date") % 3 == 0, None).otherwise(F.col("temp_mean")), F.col("precip"))
    ahead = landed(env.filter(F.dayofmonth("date") <= 20), F.col("temp_mean") + 1, F.col("precip") + 1)
    hours = F.array(F.struct(F.concat(text, F.lit("T00:00")).alias("time"), F.col("pm2_5").alias("v")), F.struct(F.concat(text, F.lit("T01:00")).alias("time"), F.when(F.dayofmonth("date") % 2 == 0, F.col("pm2_5") + 2).alias("v")))
    air = env.groupBy(F.trunc("date", "MM")).agg(F.flatten(F.collect_list(hours)).alias("z")).select(F.struct(F.col("z.time").alias("time"), F.col("z.v").alias("pm2_5")).alias("hourly"))
    return sl.merge_environment(archive, ahead, air)


PART_RATES = f""", mx AS (SELECT max(date) AS t FROM sales), ac AS (SELECT DISTINCT product_id FROM sales, mx WHERE date >= t - 90 AND units > 0),
            de AS (SELECT product_id, date, max(product_name) AS product_name, max(brand) AS brand, max(platform) AS platform, CAST(sum(units) AS DOUBLE) AS units FROM sales, mx WHERE date >= t - 540 AND units > 0 AND product_id IN (SELECT product_id FROM ac) GROUP BY 1, 2),
            r AS (SELECT product_id, arg_min(product_name, date) AS product_name, arg_min(brand, date) AS brand, arg_min(platform, date) AS platform, sum(CASE WHEN date >= DATE '{AS_OF}' - 30 THEN units ELSE 0 END) AS units_30, sum(CASE WHEN date >= DATE '{AS_OF}' - 90 THEN units ELSE 0 END) AS units_90 FROM de GROUP BY 1)"""


def _window_events(s, d):
    """The events of 400 days from the first sale on."""
    start = fx.sales(s, d).agg(F.min("date")).first()[0]
    return calendar.event_calendar(s, str(start), 400)


def _gate(s, d):
    """When sales would be refreshed: whether they are six days old, and from which day."""
    sales, today = fx.sales(s, d), date(2025, 1, 1)
    row = (tb.is_due(sales, "date", today, 6), tb.refresh_start(sales, "date", today), tb.refresh_start(sales.filter("units < 0"), "date", today))
    return s.createDataFrame([row], "due boolean, start date, first_start date")


JOBS = {
    "window_events": (_window_events, sql(f", s AS (SELECT min(date) AS a FROM sales), e AS (SELECT CAST(a + CAST(k AS INTEGER) AS DATE) AS date FROM s, (SELECT unnest(range(401)) AS k)) SELECT date, {TIER} AS tier FROM e WHERE {TIER} IS NOT NULL", "sales")),
    "refresh_gate": (_gate, sql("SELECT DATE '2025-01-01' - max(date) >= 6 AS due, DATE '2024-12-12' AS start, DATE '2022-12-03' AS first_start FROM sales", "sales")),
    "platform_catalog": (
        lambda s, d: sl.product_catalog(sl.product_demand(fx.sales(s, d)), fx.platform_stock(s, d), F.lit(AS_OF).cast("date")),
        sql(
            PART_RATES
            + """, ps AS (SELECT p_partkey, p, CAST(p_size * k AS DOUBLE) AS stock FROM part CROSS JOIN (VALUES ('A', 1), ('N', 2), ('R', 4)) v(p, k) WHERE CASE p WHEN 'A' THEN p_partkey % 2 = 0 WHEN 'N' THEN p_partkey % 3 > 0 ELSE p_partkey % 5 = 1 END)
            SELECT r.*, round(units_30 / 30, 3) AS avg_daily_30, round(units_90 / 90, 3) AS avg_daily_90, stock FROM r LEFT JOIN ps ON p_partkey = product_id QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY p = platform DESC NULLS LAST, p DESC) = 1""",
            "sales",
        ),
    ),
    "stock_reconstruction": (
        lambda s, d: se.reconstruction_summary(se.reconstruct_demand(_dense(s, d), fx.stock_history(_dense(s, d)))),
        sql(
            """, f AS (SELECT product_id, floor(quantile_cont(units, 0.5) FILTER (units > 0) + 0.5) AS fill FROM dense GROUP BY 1 HAVING count(*) >= 21 AND count(*) FILTER (units > 0) >= 3),
            m AS (SELECT dense.*, fill, units = 0 AND dayofyear(date) % 4 = 0 AND dayofyear(date) % 11 > 0 AS imp FROM dense JOIN f USING (product_id))
            SELECT product_id, count(*) FILTER (imp) AS stockout_days, CAST(sum(CASE WHEN imp THEN fill ELSE 0 END) AS DOUBLE) AS imputed_units, sum(CASE WHEN imp THEN 0 ELSE units END) AS observed_units, round(sum(CASE WHEN imp THEN fill ELSE 0 END) / sum(CASE WHEN imp THEN 0 ELSE units END) * 100, 1) AS uplift_pct FROM m GROUP BY 1""",
            "dense",
        ),
    ),
    "gmv_scopes": (
        lambda s, d: sl.gmv_scopes(fx.sales(s, d), fx.financials(s, d)),
        sql(
            """SELECT 'ALL' AS scope, date, CAST(sum(gmv) AS DOUBLE) AS gmv, CAST(sum(units) AS DOUBLE) AS units, CAST(any_value(n.net) AS DOUBLE) AS net_sales FROM sales LEFT JOIN (SELECT date, sum(net_sales) AS net FROM fin GROUP BY 1) n USING (date) GROUP BY 2
            UNION ALL SELECT 'platform:' || platform, date, CAST(sum(gmv) AS DOUBLE), CAST(sum(units) AS DOUBLE), NULL FROM sales GROUP BY 1, 2 UNION ALL SELECT 'brand:' || brand, date, CAST(sum(gmv) AS DOUBLE), CAST(sum(units) AS DOUBLE), NULL FROM sales GROUP BY 1, 2""",
            "sales",
            "fin",
        ),
    ),
    "gmv_scope_lists": (
        lambda s, d: sl.scope_lists(sl.gmv_scopes(fx.sales(s, d), fx.financials(s, d))),
        sql("SELECT 'all' AS kind, 'ALL' AS name UNION ALL SELECT DISTINCT 'platform', platform FROM sales UNION ALL SELECT DISTINCT 'brand', brand FROM sales", "sales"),
    ),
    "year_over_year": (
        lambda s, d: sl.year_over_year(sl.gmv_scopes(fx.sales(s, d), fx.financials(s, d)).filter("scope = 'ALL'")),
        sql(", g AS (SELECT date, CAST(sum(gmv) AS DOUBLE) AS gmv FROM sales GROUP BY 1) SELECT 'ALL' AS scope, a.date, a.gmv, b.gmv AS gmv_before, round((a.gmv - b.gmv) / b.gmv * 100, 1) AS change_pct FROM g a JOIN g b ON b.date = a.date - 365", "sales"),
    ),
    "product_demand_daily": (
        lambda s, d: sl.product_demand(fx.sales(s, d)),
        sql(
            """, mx AS (SELECT max(date) AS t FROM sales), ac AS (SELECT DISTINCT product_id FROM sales, mx WHERE date >= t - 90 AND units > 0)
            SELECT product_id, date, max(product_name) AS product_name, max(brand) AS brand, max(platform) AS platform, CAST(sum(units) AS DOUBLE) AS units, CAST(sum(gmv) AS DOUBLE) AS gmv FROM sales, mx WHERE date >= t - 540 AND units > 0 AND product_id IN (SELECT product_id FROM ac) GROUP BY 1, 2""",
            "sales",
        ),
    ),
    "product_catalog": (_catalog, sql(CATALOG, "bd", "bs")),
    "stock_metrics": (lambda s, d: sl.stock_metrics(_catalog(s, d), LEAD), sql(METRICS + "SELECT * FROM met", "bd", "bs")),
    "browse_catalog": (
        lambda s, d: sl.browse_catalog(_catalog(s, d), sl.stock_metrics(_catalog(s, d), LEAD), q="#1", status="urgent").select("product_id", "units_90", "status"),
        sql(METRICS + "SELECT product_id, units_90, status FROM cat JOIN met USING (product_id) WHERE contains(lower(product_id), '#1') AND status = 'urgent'", "bd", "bs"),
    ),
    "stock_status_counts": (lambda s, d: sl.stock_status_counts(sl.stock_metrics(_catalog(s, d), LEAD)), sql(METRICS + "SELECT status, count(*) AS products FROM met GROUP BY 1", "bd", "bs")),
    "latest_items": (
        lambda s, d: sl.latest_items(fx.snapshots(s, d), fx.table(s, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("item_id"))).drop("update_time"),
        "SELECT l_partkey AS item_id, CAST(l_shipdate AS DATE) AS partition_date, l_suppkey AS supplier, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1",
    ),
    "latest_stock": (
        lambda s, d: sl.latest_stock(
            fx.table(s, d, "lineitem").join(fx.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_brand").alias("brand"), F.col("l_quantity").cast("int").alias("model_stock"), F.col("l_linenumber").alias("model_reserved"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("partition_date")),
            fx.table(s, d, "events").select(F.col("user_id").alias("product_id"), F.floor("value").cast("int").alias("quantity"), F.col("ts").cast("date").alias("fetched_date")),
        ),
        """WITH c AS (SELECT l_partkey, p_name, p_brand, CAST(l_quantity AS INTEGER) AS q, l_linenumber, date_trunc('month', l_shipdate) AS pd FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT CAST(l_partkey AS VARCHAR) AS product_id, 'shopee' AS platform, CAST(sum(q) AS BIGINT) AS stock, CAST(sum(l_linenumber) AS BIGINT) AS reserved, max(p_name) AS name, max(p_brand) AS brand FROM c WHERE pd = (SELECT max(pd) FROM c) GROUP BY 1
        UNION ALL SELECT CAST(user_id AS VARCHAR), 'tiktok_shop', CAST(sum(CAST(floor(value) AS INTEGER)) AS BIGINT), 0, NULL, NULL FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1""",
    ),
    "average_price": (
        _prices,
        sql(", r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) <= 90 AS late FROM bd) SELECT product_id, round(coalesce(sum(gmv) FILTER (late) / nullif(sum(units) FILTER (late), 0), sum(gmv) / nullif(sum(units), 0), 0), 4) AS unit_price FROM r GROUP BY 1", "bd"),
    ),
    "densify": (_dense, sql("SELECT * FROM dense", "dense")),
    "demand_pattern": (
        lambda s, d: se.demand_pattern(_dense(s, d)),
        sql(
            """, f AS (SELECT product_id, count(*) AS n, count(*) FILTER (units > 0) AS nz, avg(units) FILTER (units > 0) AS m, coalesce(stddev_samp(units) FILTER (units > 0), 0) AS sd FROM dense GROUP BY 1 HAVING count(*) >= 14),
            g AS (SELECT product_id, n, nz, CASE WHEN nz < 3 THEN n ELSE round(n::DOUBLE / nz, 2) END AS adi, CASE WHEN nz < 3 THEN 0 ELSE round((sd / m) * (sd / m), 2) END AS cv2 FROM f)
            SELECT *, CASE WHEN nz < 3 THEN 'rare' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi >= 1.32 AND cv2 < 0.49 THEN 'intermittent' WHEN adi < 1.32 THEN 'erratic' ELSE 'lumpy' END AS pattern FROM g""",
            "dense",
        ),
    ),
    "stock_science": (lambda s, d: se.stock_science(_dense(s, d), fx.brand_stock(s, d), LEAD), sql(SCIENCE + "SELECT * FROM sci", "dense", "bs")),
    "reorder_plan": (
        lambda s, d: se.reorder_plan(se.stock_science(_dense(s, d), fx.brand_stock(s, d), LEAD), fx.brand_stock(s, d), LEAD),
        sql(
            SCIENCE
            + f""", rp AS (SELECT product_id, bs.stock, safety, mean_daily, CASE WHEN bs.stock IS NOT NULL AND mean_daily > 0 THEN CAST(floor(bs.stock / mean_daily + 0.5) AS INTEGER) END AS cover FROM sci LEFT JOIN bs USING (product_id) WHERE service = 95)
            SELECT product_id, cover, CASE WHEN stock IS NULL THEN 'nostock' WHEN cover IS NULL THEN 'dead' WHEN cover <= {LEAD} THEN 'urgent' WHEN cover <= {2 * LEAD} THEN 'soon' WHEN cover >= 120 THEN 'overstock' ELSE 'ok' END AS status,
            CAST(greatest(0, ceil(mean_daily * {LEAD + 30} + safety - coalesce(stock, 0))) AS INTEGER) AS order_qty FROM rp""",
            "dense",
            "bs",
        ),
    ),
    "lifecycle": (
        lambda s, d: se.lifecycle_stage(fx.brand_daily(s, d)),
        sql(
            """, sp AS (SELECT product_id, count(*) AS nr, CAST(max(date) - min(date) + 1 AS INTEGER) AS age_days, min(date) AS t0 FROM bd GROUP BY 1 HAVING count(*) >= 28),
            w AS (SELECT product_id, (date - t0) // 7 AS week, sum(units) AS units, any_value(age_days) AS age_days FROM bd JOIN sp USING (product_id) GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY week DESC) AS rk, count(*) OVER (PARTITION BY product_id) AS ws FROM w),
            k AS (SELECT product_id, week, units, age_days FROM r WHERE NOT ((age_days - 1) % 7 < 6 AND ws > 5 AND rk = 1)),
            q AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY week DESC) AS rk, row_number() OVER (PARTITION BY product_id ORDER BY week) AS nth, count(*) OVER (PARTITION BY product_id) AS ws FROM k),
            f AS (SELECT product_id, max(age_days) AS age_days, max(units) AS peak, avg(units) FILTER (rk <= 4) AS recent, avg(units) FILTER (nth <= 4) AS early, coalesce(covar_pop(units, -rk) FILTER (rk <= 8) / nullif(var_pop(-rk) FILTER (rk <= 8), 0), 0) AS sl, avg(units) FILTER (rk <= 8) AS lv FROM q WHERE ws >= 4 GROUP BY 1),
            t AS (SELECT *, CASE WHEN lv > 0 THEN sl / lv ELSE 0 END AS trend, CASE WHEN peak > 0 THEN round(recent / peak * 100) ELSE 0 END AS recent_vs_peak_pct FROM f)
            SELECT product_id, CASE WHEN age_days <= 45 THEN 'new' WHEN trend > 0.04 AND recent >= early THEN 'growing' WHEN recent_vs_peak_pct < 55 AND trend < -0.02 THEN 'declining' WHEN trend > 0.04 AND recent_vs_peak_pct < 70 THEN 'recovering' ELSE 'mature' END AS stage, age_days, recent_vs_peak_pct FROM t""",
            "bd",
        ),
    ),
    "price_elasticity": (
        lambda s, d: se.price_elasticity(fx.brand_daily(s, d)),
        sql(
            """, p AS (SELECT *, gmv / units AS price, ln(gmv / units) AS x, ln(units) AS y FROM bd WHERE units > 0 AND gmv > 0),
            f AS (SELECT product_id, count(*) AS n, avg(price) AS av, stddev_samp(price) AS sd, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy, quantile_cont(price, 0.5) AS med FROM p GROUP BY 1 HAVING count(*) >= 30),
            g AS (SELECT *, coalesce(cxy / nullif(vx, 0), 0) AS b, round(med * 0.95::DOUBLE, 2) AS th FROM f), h AS (SELECT *, greatest(vy - b * cxy, 0) AS res FROM g),
            i AS (SELECT *, coalesce(b / nullif(sqrt(res * n / (n - 2) / nullif(vx * n, 0)), 0), 0) AS t, coalesce(1 - res / nullif(vy, 0), 0) AS r2, sd / av < 0.02 AS flat FROM h),
            q AS (SELECT product_id, count(*) FILTER (price <= th) AS np, count(*) FILTER (price > th) AS no, quantile_cont(p.units, 0.5) FILTER (price <= th) AS mp, quantile_cont(p.units, 0.5) FILTER (price > th) AS mo FROM p JOIN i USING (product_id) GROUP BY 1)
            SELECT product_id, n, round(av, 2) AS avg_price, CASE WHEN flat THEN 0 ELSE round(b, 2) END AS elasticity, CASE WHEN flat THEN 0 ELSE round(t, 1) END AS t, abs(t) >= 2 AND NOT flat AS significant, CASE WHEN flat THEN 0 ELSE round(r2, 2) END AS r2,
            CASE WHEN NOT (abs(t) >= 2 AND NOT flat) THEN 'unclear' WHEN abs(b) >= 1 THEN 'high' WHEN abs(b) >= 0.4 THEN 'medium' ELSE 'inelastic' END AS sensitivity,
            CASE WHEN NOT flat AND np >= 3 AND no >= 3 AND mo > 0 THEN round((mp - mo) / mo * 100) END AS promo_lift_pct, CASE WHEN NOT flat THEN th END AS promo_threshold FROM i JOIN q USING (product_id)""",
            "bd",
        ),
    ),
    "reconstruct_demand": (
        lambda s, d: se.reconstruction_summary(se.reconstruct_demand(_dense(s, d))),
        sql(
            """, f AS (SELECT product_id, floor(quantile_cont(units, 0.5) FILTER (units > 0) + 0.5) AS fill FROM dense GROUP BY 1 HAVING count(*) >= 21 AND count(*) FILTER (units > 0) >= 3),
            i AS (SELECT dense.*, fill, count(*) FILTER (units > 0) OVER (PARTITION BY product_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS isl FROM dense JOIN f USING (product_id)),
            l AS (SELECT *, max(isl) OVER (PARTITION BY product_id) AS last, count(*) FILTER (units = 0) OVER (PARTITION BY product_id, isl) AS len FROM i),
            g AS (SELECT product_id, greatest(3, ceil(greatest(1, quantile_cont(len + 1, 0.5)) * 2.5)) AS lim FROM l WHERE units > 0 AND isl < last GROUP BY 1),
            m AS (SELECT l.*, units = 0 AND isl > 0 AND isl < last AND len >= lim AS imp FROM l JOIN g USING (product_id))
            SELECT product_id, count(*) FILTER (imp) AS stockout_days, CAST(sum(CASE WHEN imp THEN fill ELSE 0 END) AS DOUBLE) AS imputed_units, sum(CASE WHEN imp THEN 0 ELSE units END) AS observed_units, round(sum(CASE WHEN imp THEN fill ELSE 0 END) / sum(CASE WHEN imp THEN 0 ELSE units END) * 100, 1) AS uplift_pct FROM m GROUP BY 1""",
            "dense",
        ),
    ),
    "lost_sales": (
        lambda s, d: se.lost_sales(_future(s, d), fx.brand_stock(s, d), LEAD, _prices(s, d)),
        sql(
            f""", fu AS (SELECT product_id, CAST(date + 30 AS DATE) AS date, units FROM bd WHERE date > DATE '{AS_OF}' - 30 AND date <= DATE '{AS_OF}'),
            pr AS (SELECT product_id, round(coalesce(sum(gmv) FILTER (late) / nullif(sum(units) FILTER (late), 0), 0), 4) AS p FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) <= 90 AS late FROM bd) GROUP BY 1),
            r AS (SELECT fu.*, stock, row_number() OVER w AS k, sum(units) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM fu JOIN bs USING (product_id) WHERE stock IS NOT NULL WINDOW w AS (PARTITION BY product_id ORDER BY date)),
            f AS (SELECT product_id, max(stock) AS stock, CAST(min(CASE WHEN run > stock THEN k END) AS INTEGER) AS cover_days, min(CASE WHEN run > stock THEN date END) AS stockout_date, sum(CASE WHEN k <= {LEAD} THEN units ELSE 0 END) AS need, sum(units) AS total FROM r GROUP BY 1),
            u AS (SELECT *, greatest(0, floor(need - stock + 0.5)) AS lu, greatest(0, floor(total - stock + 0.5)) AS ru FROM f JOIN pr USING (product_id))
            SELECT product_id, cover_days, stockout_date, round(need) AS demand_lead_time, round(least(stock, need)) AS servable, lu AS lost_units, round(lu * p) AS lost_revenue, ru AS horizon_at_risk_units, round(ru * p) AS horizon_at_risk_revenue, CASE WHEN lu > 0 THEN 'high' WHEN cover_days <= {LEAD * 1.5} THEN 'low' ELSE 'none' END AS level FROM u""",
            "bd",
            "bs",
        ),
    ),
    "monthly_forecast": (lambda s, d: se.monthly_forecast(fx.brand_daily(s, d)), sql(MONTHS + "SELECT * FROM mf", "bd")),
    "env_monthly": (lambda s, d: sl.env_monthly(fx.env_daily(s, d)), sql(EM, "env")),
    "env_drivers": (
        lambda s, d: se.env_drivers(se.monthly_forecast(fx.brand_daily(s, d)), sl.env_monthly(fx.env_daily(s, d))),
        sql(
            MONTHS
            + f""", em AS ({EM}), lo AS (SELECT product_id, mf.units, factor, v FROM mf JOIN em USING (month) CROSS JOIN LATERAL (VALUES ('pm2_5', pm2_5), ('temp_mean', temp_mean), ('precip', precip)) z(factor, v) WHERE NOT is_forecast),
            c AS (SELECT product_id, factor, round({CORR.format(x="units", y="v")}, 2) AS corr FROM lo GROUP BY 1, 2 HAVING count(*) >= 4 AND count(v) = count(*)) SELECT *, {STRENGTH} AS strength FROM c""",
            "bd",
            "env",
        ),
    ),
    "sentiment_leads": (
        lambda s, d: se.sentiment_signals(fx.brand_daily(s, d), _mood(s, d)),
        sql(
            f""", mo AS ({MOOD}), tt AS (SELECT product_id, least(d0, m0) AS t0 FROM (SELECT product_id, min(date) AS d0 FROM bd GROUP BY 1) JOIN (SELECT product_id, min(date) AS m0 FROM mo GROUP BY 1 HAVING sum(n) >= 12) USING (product_id)),
            un AS (SELECT product_id, (date - t0) // 7 AS week, sum(units) AS units FROM bd JOIN tt USING (product_id) GROUP BY 1, 2), sa AS (SELECT product_id, (date - t0) // 7 AS week, CAST(sum(n) AS DOUBLE) AS volume, avg(net) AS net, avg(avg_rating) AS rating FROM mo JOIN tt USING (product_id) GROUP BY 1, 2),
            bo AS (SELECT product_id, week, units, volume, net, rating FROM un FULL JOIN sa USING (product_id, week)), gr AS (SELECT product_id, unnest(range(min(week), max(week) + 1)) AS week FROM bo GROUP BY 1 HAVING max(week) - min(week) + 1 >= 8),
            de AS (SELECT product_id, week, coalesce(units, 0) AS units, coalesce(volume, 0) AS volume, coalesce(net, 0) AS net, coalesce(rating, 0) AS rating FROM gr LEFT JOIN bo USING (product_id, week)),
            la AS (SELECT *, {", ".join(f"lead(units, {k}) OVER (PARTITION BY product_id ORDER BY week) AS u{k}" for k in range(5))} FROM de),
            lo AS (SELECT product_id, signal, s, u0, u1, u2, u3, u4 FROM la CROSS JOIN LATERAL (VALUES ('review_volume', volume), ('net_sentiment', net), ('avg_rating', rating)) z(signal, s)),
            cc AS (SELECT product_id, signal, lag, round(CASE lag {" ".join(f"WHEN {k} THEN " + CORR.format(x="s", y=f"u{k}") for k in range(5))} END, 2) AS corr FROM lo CROSS JOIN (SELECT unnest(range(0, 5)) AS lag) GROUP BY 1, 2, 3),
            be AS (SELECT product_id, signal, CAST(CASE WHEN corr = 0 THEN 0 ELSE lag END AS INTEGER) AS best_lag_weeks, corr FROM cc QUALIFY row_number() OVER (PARTITION BY product_id, signal ORDER BY abs(corr) DESC, lag) = 1)
            SELECT *, {STRENGTH} AS strength FROM be""",
            "bd",
        ),
    ),
    "sentiment_series": (
        lambda s, d: se.sentiment_series(fx.brand_daily(s, d), _mood(s, d)),
        sql(
            f""", mo AS ({MOOD}), tt AS (SELECT product_id, least(d0, m0) AS t0 FROM (SELECT product_id, min(date) AS d0 FROM bd GROUP BY 1) JOIN (SELECT product_id, min(date) AS m0 FROM mo GROUP BY 1 HAVING sum(n) >= 12) USING (product_id)),
            un AS (SELECT product_id, (date - t0) // 7 AS week, sum(units) AS units FROM bd JOIN tt USING (product_id) GROUP BY 1, 2), sa AS (SELECT product_id, (date - t0) // 7 AS week, CAST(sum(n) AS DOUBLE) AS volume, avg(net) AS net, avg(avg_rating) AS rating FROM mo JOIN tt USING (product_id) GROUP BY 1, 2),
            bo AS (SELECT product_id, week, units, volume, net, rating FROM un FULL JOIN sa USING (product_id, week)), gr AS (SELECT product_id, unnest(range(min(week), max(week) + 1)) AS week FROM bo GROUP BY 1 HAVING max(week) - min(week) + 1 >= 8),
            de AS (SELECT product_id, week, coalesce(units, 0) AS units, coalesce(volume, 0) AS volume, coalesce(net, 0) AS net, coalesce(rating, 0) AS rating FROM gr LEFT JOIN bo USING (product_id, week))
            SELECT product_id, CAST(t0 + CAST(week * 7 AS INTEGER) AS DATE) AS week_start, {", ".join(f"round(coalesce(({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0), 0), 3) AS {n}" for c, n in (("units", "units_z"), ("volume", "reviews_z"), ("net", "net_z")))} FROM de JOIN tt USING (product_id) WINDOW w AS (PARTITION BY product_id)""",
            "bd",
        ),
    ),
    "event_calendar": (
        lambda s, d: calendar.with_events(fx.sales(s, d).select("date").distinct()),
        sql(f", e AS (SELECT DISTINCT date FROM sales) SELECT date, {TIER} AS tier FROM e WHERE {TIER} IS NOT NULL", "sales"),
    ),
    "part_catalog": (
        lambda s, d: sl.product_catalog(sl.product_demand(fx.sales(s, d)), fx.part_stock(s, d), F.lit(AS_OF).cast("date")),
        sql(
            f""", mx AS (SELECT max(date) AS t FROM sales), ac AS (SELECT DISTINCT product_id FROM sales, mx WHERE date >= t - 90 AND units > 0),
            de AS (SELECT product_id, date, max(product_name) AS product_name, max(brand) AS brand, max(platform) AS platform, CAST(sum(units) AS DOUBLE) AS units FROM sales, mx WHERE date >= t - 540 AND units > 0 AND product_id IN (SELECT product_id FROM ac) GROUP BY 1, 2),
            r AS (SELECT product_id, arg_min(product_name, date) AS product_name, arg_min(brand, date) AS brand, arg_min(platform, date) AS platform, sum(CASE WHEN date >= DATE '{AS_OF}' - 30 THEN units ELSE 0 END) AS units_30, sum(CASE WHEN date >= DATE '{AS_OF}' - 90 THEN units ELSE 0 END) AS units_90 FROM de GROUP BY 1)
            SELECT r.*, round(units_30 / 30, 3) AS avg_daily_30, round(units_90 / 90, 3) AS avg_daily_90, CAST(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 3 END AS DOUBLE) AS stock FROM r LEFT JOIN part ON p_partkey = product_id""",
            "sales",
        ),
    ),
    "brand_list": (lambda s, d: sl.name_list(fx.products(s, d), "brand"), sql("SELECT DISTINCT brand FROM prod WHERE brand IS NOT NULL", "prod")),
    "stock_snapshot": (
        lambda s, d: sl.stock_snapshot(fx.table(s, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("stock"), F.col("l_linenumber").cast("long").alias("reserved")), AS_OF),
        f"SELECT l_partkey AS product_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS stock, CAST(sum(l_linenumber) AS BIGINT) AS reserved, DATE '{AS_OF}' AS date FROM lineitem GROUP BY 1",
    ),
    "env_merge": (
        _merged_env,
        sql(
            """, a AS (SELECT date, CASE WHEN day(date) % 3 = 0 THEN NULL ELSE temp_mean END AS t, precip AS p FROM env WHERE month(date) <> 7), f AS (SELECT date, temp_mean + 1 AS t, precip + 1 AS p FROM env WHERE day(date) <= 20),
            q AS (SELECT date, round(avg(v), 1) AS pm2_5 FROM (SELECT date, pm2_5 AS v FROM env UNION ALL SELECT date, pm2_5 + 2 FROM env WHERE day(date) % 2 = 0) GROUP BY 1)
            SELECT date, pm2_5, coalesce(a.t, f.t) AS temp_mean, coalesce(a.p, f.p) AS precip FROM a FULL JOIN f USING (date) FULL JOIN q USING (date)""",
            "env",
        ),
    ),
}
