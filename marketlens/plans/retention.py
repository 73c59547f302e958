"""Retention jobs."""

from __future__ import annotations

import uuid

from marketlens.operators import buyer_state as bs
from marketlens.operators import retention as r
from marketlens.plans.sql import sql
from marketlens.sources import fixtures as fx
from marketlens.sources.scratch import tables_dir, written


def _base(spark, d):
    return r.buyer_base(fx.orders(spark, d), fx.order_items(spark, d))


def _state(spark, d):
    """The buyers' months after three deltas of days, the third of which brings days of the second again."""
    path, orders, items = f"{tables_dir(spark)}/buyers-{uuid.uuid4().hex}", written(fx.orders(spark, d), "orders"), written(fx.order_items(spark, d), "items")
    days = sorted(str(r[0]) for r in orders.select("create_date").distinct().collect())
    third = len(days) // 3
    for part in (days[:third], days[third : 2 * third + 50], days[2 * third :]):
        if part:
            bs.apply_delta(spark, path, orders, items, part)
    return bs.months(spark, path)


AS_OF = "1998-08-01"
SEGMENT = """CASE WHEN orders >= 3 AND recency <= 90 THEN 'champion' WHEN orders >= 2 AND recency <= 180 THEN 'loyal' WHEN orders = 1 AND recency <= 90 THEN 'new' WHEN orders = 1 AND recency <= 180 THEN 'promising'
  WHEN orders >= 3 AND recency > 365 THEN 'cannot_lose' WHEN orders >= 2 AND recency <= 365 THEN 'at_risk' WHEN recency <= 365 THEN 'hibernating' ELSE 'lost' END"""
GAPS = "SELECT buyer, row_number() OVER w AS rn, CAST(lead(d) OVER w - d AS INTEGER) AS gap FROM ord WINDOW w AS (PARTITION BY buyer ORDER BY d, order_sn)"

JOBS = {
    "incremental_base": (lambda s, d: bs.base(_state(s, d)), sql("SELECT buyer, orders, spend, first_order, last_order, brands, recency FROM base", "base")),
    "incremental_monthly": (
        lambda s, d: r.retention_monthly(_state(s, d)),
        sql(
            """, f AS (SELECT *, date_trunc('month', d) AS month, date_trunc('month', min(d) OVER (PARTITION BY buyer)) AS first FROM ord)
            SELECT CAST(month AS DATE) AS month, count(DISTINCT CASE WHEN month = first THEN buyer END) AS new_customers, count(DISTINCT CASE WHEN month <> first THEN buyer END) AS returning_customers, count(*) AS orders FROM f GROUP BY 1""",
            "ord",
        ),
    ),
    "rfm_segments": (
        lambda s, d: r.rfm_segments(_base(s, d)),
        sql(
            f"""SELECT {SEGMENT} AS segment, count(*) AS customers, round(avg(recency)) AS avg_recency, round(avg(orders), 2) AS avg_frequency,
            round(CAST(sum(spend) AS DOUBLE) / count(*)) AS avg_monetary, round(CAST(sum(spend) AS DOUBLE)) AS total_spend FROM base GROUP BY 1""",
            "base",
        ),
    ),
    "retention_summary": (
        lambda s, d: r.retention_summary(fx.orders(s, d)),
        sql(
            """, g AS (SELECT brand_id AS scope, buyer, count(*) AS o FROM ord WHERE brand_id IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'ALL', buyer, count(*) FROM ord GROUP BY 2)
            SELECT scope, count(*) AS customers, count(*) FILTER (o >= 2) AS repeat_customers, count(*) FILTER (o = 1) AS one_time, CAST(sum(o) AS BIGINT) AS total_orders,
            round(CAST(count(*) FILTER (o >= 2) AS DOUBLE) / count(*) * 100, 1) AS repeat_rate, round(avg(o), 2) AS avg_orders FROM g GROUP BY 1""",
            "ord",
        ),
    ),
    "retention_monthly": (
        lambda s, d: r.retention_monthly(fx.orders(s, d)),
        sql(
            """, f AS (SELECT *, date_trunc('month', d) AS month, date_trunc('month', min(d) OVER (PARTITION BY buyer)) AS first FROM ord)
            SELECT CAST(month AS DATE) AS month, count(DISTINCT CASE WHEN month = first THEN buyer END) AS new_customers, count(DISTINCT CASE WHEN month <> first THEN buyer END) AS returning_customers, count(*) AS orders FROM f GROUP BY 1""",
            "ord",
        ),
    ),
    "cohort_matrix": (
        lambda s, d: r.cohort_matrix(fx.orders(s, d), AS_OF),
        sql(
            f""", f AS (SELECT buyer, date_trunc('month', d) AS month, date_trunc('month', min(d) OVER (PARTITION BY buyer)) AS cohort FROM ord),
            c AS (SELECT CAST(cohort AS DATE) AS cohort, CAST(datediff('month', cohort, month) AS INTEGER) AS months_since, count(DISTINCT buyer) AS customers FROM f
            WHERE cohort >= date_trunc('month', DATE '{AS_OF}' - INTERVAL 17 MONTH) GROUP BY 1, 2)
            SELECT cohort, months_since, customers, round(CAST(customers AS DOUBLE) / max(CASE WHEN months_since = 0 THEN customers END) OVER (PARTITION BY cohort) * 100) AS percent_of_first FROM c WHERE months_since BETWEEN 0 AND 12""",
            "ord",
        ),
    ),
    "order_distribution": (
        lambda s, d: r.order_distribution(fx.orders(s, d)),
        sql(", p AS (SELECT buyer, count(*) AS o FROM ord GROUP BY 1) SELECT CASE WHEN o >= 5 THEN '5+' ELSE CAST(o AS VARCHAR) END AS bucket, count(*) AS customers FROM p GROUP BY 1", "ord"),
    ),
    "top_customers": (
        lambda s, d: r.top_customers(_base(s, d)),
        sql("SELECT buyer, orders, round(CAST(spend AS DOUBLE)) AS spend, first_order, last_order, brands FROM base ORDER BY orders DESC, base.spend DESC, buyer LIMIT 100", "base"),
    ),
    "at_risk": (
        lambda s, d: r.at_risk(_base(s, d)),
        sql("SELECT buyer, orders, round(CAST(spend AS DOUBLE)) AS spend, last_order, recency AS days_since, brands FROM base WHERE orders >= 2 AND recency BETWEEN 120 AND 540 ORDER BY round(CAST(base.spend AS DOUBLE)) DESC, buyer LIMIT 100", "base"),
    ),
    "gap_histogram": (
        lambda s, d: r.gap_histogram(r.purchase_gaps(fx.orders(s, d))),
        sql(f", g AS ({GAPS}) SELECT CASE WHEN gap <= 30 THEN '0-30' WHEN gap <= 60 THEN '31-60' WHEN gap <= 90 THEN '61-90' WHEN gap <= 180 THEN '91-180' WHEN gap <= 365 THEN '181-365' ELSE '365+' END AS bucket, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1", "ord"),
    ),
    "retention_kpi": (
        lambda s, d: r.retention_kpi(r.purchase_gaps(fx.orders(s, d)), _base(s, d)),
        sql(
            f""", g AS ({GAPS}), s2 AS (SELECT gap FROM g WHERE rn = 1 AND gap IS NOT NULL)
            SELECT (SELECT CAST(quantile_disc(gap, 0.5) AS INTEGER) FROM s2) AS median_days_to_2nd, (SELECT round(avg(gap)) FROM s2) AS avg_days_to_2nd, (SELECT count(*) FROM s2) AS repeat2,
            round(CAST(sum(CASE WHEN orders >= 2 THEN spend ELSE 0 END) AS DOUBLE) / CAST(sum(spend) AS DOUBLE) * 100, 1) AS returning_rev_pct, round(CAST(sum(spend) AS DOUBLE)) AS total_revenue FROM base""",
            "base",
        ),
    ),
    "brand_mix": (
        lambda s, d: r.brand_mix(fx.orders(s, d)),
        sql(", p AS (SELECT buyer, count(DISTINCT brand_id) AS nb FROM ord WHERE brand_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN nb <= 1 THEN '1' WHEN nb = 2 THEN '2' ELSE '3+' END AS bucket, count(*) AS customers FROM p GROUP BY 1", "ord"),
    ),
    "review_retention": (
        lambda s, d: r.review_retention(fx.orders(s, d), fx.comments(s, d)),
        sql(
            """, b AS (SELECT buyer, count(DISTINCT order_sn) AS freq FROM ord GROUP BY 1), c AS (SELECT buyer, min(rating) AS worst FROM com WHERE comment <> '' GROUP BY 1)
            SELECT CASE WHEN c.buyer IS NULL THEN 'none' WHEN worst <= 2 THEN 'bad' WHEN worst = 3 THEN 'middle' ELSE 'good' END AS grp, count(*) AS customers, round(CAST(count(*) FILTER (freq >= 2) AS DOUBLE) / count(*) * 100, 1) AS repeat_rate
            FROM b LEFT JOIN c USING (buyer) GROUP BY 1""",
            "ord",
            "com",
        ),
    ),
    "pareto": (
        lambda s, d: r.pareto(_base(s, d)),
        sql(
            ", r AS (SELECT spend, percent_rank() OVER (ORDER BY spend DESC) AS pr FROM base) SELECT "
            + ", ".join(f"round(CAST(sum(CASE WHEN pr < {c} THEN spend ELSE 0 END) AS DOUBLE) / CAST(sum(spend) AS DOUBLE) * 100, 1) AS {n}" for c, n in ((0.01, "top1"), (0.05, "top5"), (0.1, "top10"), (0.2, "top20")))
            + " FROM r",
            "base",
        ),
    ),
    "retention_derived": (
        lambda s, d: r.derived_kpis(fx.orders(s, d), _base(s, d)),
        sql(
            f""", p AS (SELECT buyer, count(*) AS o FROM ord GROUP BY 1), g AS (SELECT *, {SEGMENT} AS segment FROM base)
            """
            + " UNION ALL ".join(f"SELECT 'ladder_{k}_{k + 1}' AS metric, round(CAST(count(*) FILTER (o >= {k + 1}) AS DOUBLE) / count(*) FILTER (o >= {k}) * 100, 1) AS value FROM p" for k in range(1, 5))
            + """ UNION ALL SELECT 'churn_pct', round(CAST(count(*) FILTER (segment IN ('lost', 'cannot_lose')) AS DOUBLE) / count(*) * 100, 1) FROM g
            UNION ALL SELECT 'core_customers', CAST(count(*) FILTER (segment IN ('champion', 'loyal')) AS DOUBLE) FROM g
            UNION ALL SELECT 'win_back_value', round(CAST(sum(CASE WHEN segment IN ('at_risk', 'cannot_lose') THEN spend ELSE 0 END) AS DOUBLE)) FROM g""",
            "base",
        ),
    ),
    "reviewer_gap": (
        lambda s, d: r.reviewer_gap(r.review_retention(fx.orders(s, d), fx.comments(s, d))),
        sql(
            """, b AS (SELECT buyer, count(DISTINCT order_sn) AS freq FROM ord GROUP BY 1), c AS (SELECT DISTINCT buyer, min(rating) OVER (PARTITION BY buyer) AS worst FROM com WHERE comment <> ''),
            g AS (SELECT CASE WHEN c.buyer IS NULL THEN 'none' WHEN worst <= 2 THEN 'bad' WHEN worst = 3 THEN 'middle' ELSE 'good' END AS grp, count(*) AS n, round(CAST(count(*) FILTER (freq >= 2) AS DOUBLE) / count(*) * 100, 1) AS rate FROM b LEFT JOIN c USING (buyer) GROUP BY 1),
            v AS (SELECT coalesce(round(sum(rate * n) FILTER (grp <> 'none') / sum(n) FILTER (grp <> 'none'), 1), 0) AS reviewer_rate, max(rate) FILTER (grp = 'none') AS other_rate FROM g)
            SELECT *, round(reviewer_rate - other_rate, 1) AS gap FROM v""",
            "ord",
            "com",
        ),
    ),
    "loyalty_rank": (
        lambda s, d: r.loyalty_rank(r.retention_summary(fx.orders(s, d))),
        sql(
            """, g AS (SELECT brand_id AS scope, buyer, count(*) AS o FROM ord WHERE brand_id IS NOT NULL GROUP BY 1, 2), v AS (SELECT scope, count(*) AS customers, round(CAST(count(*) FILTER (o >= 2) AS DOUBLE) / count(*) * 100, 1) AS repeat_rate FROM g GROUP BY 1)
            SELECT *, CAST(row_number() OVER (ORDER BY repeat_rate DESC, scope) AS INTEGER) AS rank FROM v""",
            "ord",
        ),
    ),
    "value_by_segment": (
        lambda s, d: r.value_by_segment(r.rfm_segments(_base(s, d))),
        sql(
            f""", v AS (SELECT {SEGMENT} AS segment, round(CAST(sum(spend) AS DOUBLE)) AS total_spend FROM base GROUP BY 1)
            SELECT *, round(total_spend / max(total_spend) OVER () * 100, 1) AS of_largest, round(total_spend / sum(total_spend) OVER () * 100, 1) AS of_all FROM v""",
            "base",
        ),
    ),
    "brand_scope": (
        lambda s, d: r.brand_scope(r.retention_summary(fx.orders(s, d)), r.top_customers(_base(s, d)), r.at_risk(_base(s, d))),
        sql(
            """, t AS (SELECT brands FROM base ORDER BY orders DESC, base.spend DESC, buyer LIMIT 100), q AS (SELECT round(CAST(spend AS DOUBLE)) AS spend, brands FROM base WHERE orders >= 2 AND recency BETWEEN 120 AND 540 ORDER BY round(CAST(base.spend AS DOUBLE)) DESC, buyer LIMIT 100),
            g AS (SELECT brand_id AS scope, buyer, count(*) AS o FROM ord WHERE brand_id IS NOT NULL GROUP BY 1, 2), v AS (SELECT scope, count(*) AS customers, round(CAST(count(*) FILTER (o >= 2) AS DOUBLE) / count(*) * 100, 1) AS repeat_rate FROM g GROUP BY 1)
            SELECT *, (SELECT count(*) FROM t WHERE list_contains(string_split(brands, ', '), scope)) AS vips, (SELECT count(*) FROM q WHERE list_contains(string_split(brands, ', '), scope)) AS at_risk,
            coalesce((SELECT sum(spend) FROM q WHERE list_contains(string_split(brands, ', '), scope)), 0) AS win_back_value FROM v""",
            "base",
        ),
    ),
}
