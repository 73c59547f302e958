"""SQL of the forecast jobs: the recursions as a recursive table, a step a day; and the regression's elimination, a step a variable."""

from __future__ import annotations

from marketlens.functions.rules import WEATHER_FACTORS

NAMES = ["moving_avg", "linear_seasonal", "holt_winters", "croston", "sba", "tsb"]
# Halves go up; values are taken to six decimals first, so that a half is one whatever the order of the sums that led to it.
ONE = "sign({0}) * floor(round(abs({0}) * 10, 6) + 0.5) / 10"


def _series(source: str) -> str:
    """Dense recent days (``day``) of ``source``'s products, and each series as a whole and without its test days (``ser``)."""
    return f""", fs AS (SELECT product_id, date, units FROM {source}),
  ft AS (SELECT product_id, max(date) AS top FROM fs GROUP BY 1),
  fr AS (SELECT fs.* FROM fs JOIN ft USING (product_id) WHERE top - date <= 540),
  fg AS (SELECT product_id, CAST(unnest(generate_series(min(date), CASE WHEN min(date) < max(date) THEN max(date) - 1 ELSE max(date) END, INTERVAL 1 DAY)) AS DATE) AS date FROM fr GROUP BY 1),
  fd AS (SELECT fg.product_id, fg.date, coalesce(units, 0) AS y, row_number() OVER (PARTITION BY fg.product_id ORDER BY fg.date) - 1 AS i, count(*) OVER (PARTITION BY fg.product_id) AS n FROM fg LEFT JOIN fr ON fr.product_id = fg.product_id AND fr.date = fg.date),
  day AS (SELECT * FROM fd WHERE n >= 14),
  info AS (SELECT product_id, n, min(date) AS first, count(*) FILTER (y > 0) = 0 OR n / count(*) FILTER (y > 0) >= 1.32 AS sporadic, CAST(greatest(14, least(42, floor(n * 0.2::DOUBLE + 0.5))) AS BIGINT) AS test FROM day GROUP BY 1, 2),
  ser AS (SELECT product_id, fit, i, y, m, dayofweek(date) AS dow FROM (SELECT day.*, fit, CASE fit WHEN 'full' THEN day.n ELSE day.n - test END AS m FROM day JOIN info USING (product_id) CROSS JOIN (VALUES ('full'), ('train')) f(fit)) WHERE i < m),
  sm AS (SELECT product_id, fit, m, avg(y) AS mean, avg(y) FILTER (i >= m - 28) AS level, count(*) FILTER (y > 0) AS sold, avg(y) FILTER (y > 0) AS sold_mean, avg(y) FILTER (i < 14) AS l0, (avg(y) FILTER (i >= 7 AND i < 14) - avg(y) FILTER (i < 7)) / 7 AS t0,
      coalesce(covar_pop(y, i) FILTER (i >= m - 180 AND y > 0) / nullif(var_pop(i) FILTER (i >= m - 180 AND y > 0), 0), 0) AS slope, avg(i) FILTER (i >= m - 180 AND y > 0) AS mx, coalesce(avg(y) FILTER (i >= m - 180 AND y > 0), avg(y)) AS my FROM ser GROUP BY 1, 2, 3),
  st AS (SELECT *, my - slope * coalesce(mx, 0) AS start FROM sm),
  wd AS (SELECT unnest(range(7)) AS dow),
  wk AS (SELECT product_id, fit, dow, quantile_cont(y / level, 0.5) FILTER (i >= ser.m - 84 AND y > 0 AND level > 0) AS ma, quantile_cont(y / greatest(0, start + slope * i), 0.5) FILTER (i >= ser.m - 365 AND y > 0 AND start + slope * i > 0) AS ls FROM ser JOIN st USING (product_id, fit) GROUP BY 1, 2, 3),
  wf AS (SELECT product_id, fit, dow, ma / coalesce(nullif(avg(ma) OVER p, 0), 1) AS ma, ls / coalesce(nullif(avg(ls) OVER p, 0), 1) AS ls FROM (SELECT st.product_id, st.fit, wd.dow, coalesce(ma, 1) AS ma, coalesce(ls, 1) AS ls FROM st CROSS JOIN wd LEFT JOIN wk ON wk.product_id = st.product_id AND wk.fit = st.fit AND wk.dow = wd.dow) WINDOW p AS (PARTITION BY product_id, fit)),
  sn AS (SELECT product_id, fit, list(s ORDER BY r) AS s FROM (SELECT ser.product_id, ser.fit, i % 7 AS r, avg(y - l0) AS s FROM ser JOIN st USING (product_id, fit) WHERE ser.m >= 21 GROUP BY 1, 2, 3) GROUP BY 1, 2),
  rec AS (
    SELECT product_id, fit, CAST(-1 AS BIGINT) AS i, CAST(l0 AS DOUBLE) AS level, CAST(t0 AS DOUBLE) AS trend, s, CAST(NULL AS DOUBLE) AS fitted, CAST(0 AS DOUBLE) AS size, CAST(1 AS DOUBLE) AS gap, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS cnt, CAST(sold AS DOUBLE) / m AS chance, CAST(sold_mean AS DOUBLE) AS tsize FROM st LEFT JOIN sn USING (product_id, fit)
    UNION ALL
    SELECT product_id, fit, i, nl, 0.05 * (nl - level) + 0.95 * trend, s[2:7] || [0.25 * (y - nl) + 0.75 * s[1]], greatest(level + trend + s[1], 0),
      CASE WHEN y > 0 THEN CASE WHEN cnt > 0 THEN 0.1 * y + 0.9 * size ELSE y END ELSE size END, CASE WHEN y > 0 THEN CASE WHEN cnt > 0 THEN 0.1 * (i - last) + 0.9 * gap ELSE i + 1 END ELSE gap END, CASE WHEN y > 0 THEN i ELSE last END, CASE WHEN y > 0 THEN cnt + 1 ELSE cnt END,
      CASE WHEN y > 0 THEN 0.05 ELSE 0 END + 0.95 * chance, CASE WHEN y > 0 THEN 0.1 * y + 0.9 * tsize ELSE tsize END
    FROM (SELECT rec.product_id, rec.fit, ser.i, ser.y, rec.level, rec.trend, rec.s, rec.size, rec.gap, rec.last, rec.cnt, rec.chance, rec.tsize, 0.3 * (ser.y - rec.s[1]) + 0.7 * (rec.level + rec.trend) AS nl FROM rec JOIN ser ON ser.product_id = rec.product_id AND ser.fit = rec.fit AND ser.i = rec.i + 1)),
  ends AS (SELECT st.*, rec.level AS hl, rec.trend AS ht, rec.s, CASE WHEN cnt < 2 THEN mean ELSE size / gap END AS cr, CASE WHEN sold < 2 THEN mean ELSE chance * tsize END AS ts, dayofweek(first) AS d0 FROM st JOIN rec ON rec.product_id = st.product_id AND rec.fit = st.fit AND rec.i = st.m - 1 JOIN info ON info.product_id = st.product_id),
  ah AS (SELECT ends.*, j, (d0 + m + j - 1) % 7 AS dow FROM ends CROSS JOIN (SELECT unnest(range(1, 43)) AS j)),
  gu AS (SELECT product_id, fit, m, j, model, v FROM (SELECT ah.product_id, ah.fit, ah.m, j, greatest(level * wf.ma, 0) AS moving_avg, greatest(start + slope * (m - 1 + j), 0) * wf.ls AS linear_seasonal, CASE WHEN m >= 21 THEN greatest(hl + j * ht + s[1 + (j - 1) % 7], 0) END AS holt_winters, greatest(cr, 0) AS croston, greatest(cr * 0.95, 0) AS sba, greatest(ts, 0) AS tsb
      FROM ah JOIN wf ON wf.product_id = ah.product_id AND wf.fit = ah.fit AND wf.dow = ah.dow) UNPIVOT INCLUDE NULLS (v FOR model IN ({', '.join(NAMES)}))),
  bt AS (SELECT gu.product_id, model, CASE WHEN sporadic THEN (j - 1) // 7 ELSE j - 1 END AS bucket, sum(v) AS g, sum(y) AS r FROM gu JOIN info USING (product_id) JOIN day ON day.product_id = gu.product_id AND day.i = gu.m + j - 1 WHERE fit = 'train' AND j <= test AND gu.m >= 14 AND v IS NOT NULL GROUP BY 1, 2, 3),
  sc AS (SELECT product_id, model, sum(abs(g - r)) / sum(r) * 100 AS w, avg(abs(g - r) / r) FILTER (r > 0) * 100 AS mp, sum(g - r) / sum(r) * 100 AS b FROM bt GROUP BY 1, 2 HAVING sum(r) > 0),
  mo AS (SELECT unnest({NAMES!r}) AS model, unnest(range(6)) AS k),
  ca AS (SELECT info.product_id, mo.model, k, {ONE.format('w')} AS wape, {ONE.format('mp')} AS mape, {ONE.format('b')} AS bias, info.n >= 21 OR mo.model <> 'holt_winters' AS eligible, sporadic FROM info CROSS JOIN mo LEFT JOIN sc ON sc.product_id = info.product_id AND sc.model = mo.model WHERE sporadic OR k < 3),
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY wape NULLS LAST, k) AS INTEGER) AS rank FROM ca),
  ch AS (SELECT product_id, model, CASE WHEN count(wape) OVER (PARTITION BY product_id) > 0 THEN rank = 1 ELSE model = CASE WHEN sporadic THEN 'croston' ELSE 'moving_avg' END END AS chosen, wape, mape, bias, eligible, rank FROM rk),
  be AS (SELECT * FROM ch WHERE chosen) """


CANDIDATES = _series("{}") + "SELECT CAST(product_id AS VARCHAR) AS product_id, model, wape, eligible, rank, chosen FROM ch"
TOTALS = _series("{}") + "SELECT CAST(be.product_id AS VARCHAR) AS product_id, be.model, wape, forecast_sum FROM be JOIN (SELECT product_id, model, sum(floor(round(v, 6) + 0.5)) AS forecast_sum FROM gu WHERE fit = 'full' AND j <= 30 GROUP BY 1, 2) f ON f.product_id = be.product_id AND f.model = be.model"
POINTS = (
    _series("{}")
    + """, pa AS (SELECT be.product_id, be.model, day.i, day.y, CASE be.model WHEN 'moving_avg' THEN greatest(e.level * wf.ma, 0) WHEN 'linear_seasonal' THEN greatest(start + slope * day.i, 0) * wf.ls WHEN 'holt_winters' THEN rec.fitted WHEN 'croston' THEN greatest(cr, 0) WHEN 'sba' THEN greatest(cr * 0.95, 0) ELSE greatest(ts, 0) END AS v
    FROM be JOIN ends e ON e.product_id = be.product_id AND e.fit = 'full' JOIN day ON day.product_id = be.product_id JOIN wf ON wf.product_id = be.product_id AND wf.fit = 'full' AND wf.dow = dayofweek(day.date) JOIN rec ON rec.product_id = be.product_id AND rec.fit = 'full' AND rec.i = day.i),
  bn AS (SELECT pa.product_id, 1.28 * coalesce(stddev_samp(y - v), 0) AS band FROM pa JOIN info USING (product_id) WHERE i >= n - 90 GROUP BY 1),
  pt AS (SELECT product_id, model, i, y, v, FALSE AS is_future FROM pa UNION ALL SELECT be.product_id, be.model, gu.m + j - 1, NULL, v, TRUE FROM be JOIN gu ON gu.product_id = be.product_id AND gu.model = be.model AND fit = 'full' WHERE j <= 30)
SELECT CAST(pt.product_id AS VARCHAR) AS product_id, CAST(first + CAST(i AS INTEGER) AS DATE) AS date, y AS actual, floor(round(v, 6) + 0.5) AS forecast, floor(round(greatest(v - band, 0), 6) + 0.5) AS lower, floor(round(v + band, 6) + 0.5) AS upper, is_future, pt.model, wape, mape, bias, CAST(n AS INTEGER) AS days
FROM pt JOIN info USING (product_id) JOIN bn USING (product_id) JOIN be USING (product_id)"""
)


def recursive(text: str) -> str:
    """The tables above refer to themselves in one place."""
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


TERMS = ["trend", "pm2_5", "temp_mean", "precip"]


def _regression() -> str:
    """Correlations of the terms and the sales, then an elimination a term; a term that doesn't bear on a product's kind stands apart."""
    of = {"trend": "CAST(week AS DOUBLE)", "pm2_5": "pm2_5", "temp_mean": "temp_mean", "precip": "coalesce(precip, 0)", "y": "units"}
    v, size = [*TERMS, "y"], 5
    cells = [(i, j) for i in range(size) for j in range(size)]
    own = [f"list_contains(own, '{t}')" for t in TERMS] + ["TRUE"]
    covariance = ", ".join(f"covar_samp({of[v[i]]}, {of[v[j]]}) AS m{i}{j}" for i, j in cells)
    correlation = ", ".join(
        (f"CASE WHEN NOT {own[i]} OR m{i}{i} > 0 THEN 1.0::DOUBLE ELSE 0 END" if i == j else f"CASE WHEN {own[i]} AND {own[j]} AND m{i}{i} > 0 AND m{j}{j} > 0 THEN m{i}{j} / sqrt(m{i}{i} * m{j}{j}) ELSE 0.0::DOUBLE END") + f" AS m{i}{j}" for i, j in cells
    )

    def turned(k: int) -> str:
        value = lambda i, j: "1 / d" if i == k == j else f"-m{i}{k} / d" if j == k else f"m{k}{j} / d" if i == k else f"m{i}{j} - m{i}{k} * m{k}{j} / d"
        return ", ".join(f"{value(i, j)} AS m{i}{j}" for i, j in cells)

    kinds = "CASE kind " + " ".join(f"WHEN '{k}' THEN {['trend', *f]!r}" for k, f in WEATHER_FACTORS.items()) + " END"
    names = "[" + ", ".join(f"'{k}'" for k in WEATHER_FACTORS) + "]"
    out = f""", w AS (SELECT dense.product_id, (date - first) // 7 AS week, units, pm2_5, temp_mean, precip FROM dense JOIN (SELECT product_id, min(date) AS first FROM dense GROUP BY 1 HAVING count(*) >= 56) USING (product_id) LEFT JOIN env USING (date)),
  ww AS (SELECT product_id, week, sum(units) AS units, avg(pm2_5) AS pm2_5, avg(temp_mean) AS temp_mean, avg(precip) AS precip FROM w GROUP BY 1, 2),
  kd AS (SELECT product_id, {kinds} AS own FROM (SELECT DISTINCT p_brand AS product_id, {names}[CAST(substr(p_brand, 7, 2) AS INTEGER) % {len(WEATHER_FACTORS)} + 1] AS kind FROM part)),
  cv AS (SELECT product_id, count(*) AS n, {covariance} FROM ww WHERE pm2_5 IS NOT NULL AND temp_mean IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
  r0 AS (SELECT product_id, n, own, 1 + len(own) AS k, {correlation} FROM cv JOIN kd USING (product_id) WHERE n > 2 + len(own))"""
    for k in range(4):
        out += f""",
  r{k + 1} AS (SELECT product_id, n, own, k, {turned(k)} FROM (SELECT *, CASE WHEN m{k}{k} > 1e-10 THEN m{k}{k} END AS d FROM r{k}))"""
    rows = ", ".join(f"({i}, '{t}', m{i}4, m{i}{i})" for i, t in enumerate(TERMS))
    return (
        out
        + f""",
  co AS (SELECT product_id, n, own, k, m44, factor, beta, CASE WHEN m44 * inv > 0 THEN beta / sqrt(m44 * inv / (n - k)) ELSE 0 END AS t FROM r4 CROSS JOIN LATERAL (VALUES {rows}) z(i, factor, beta, inv) WHERE list_contains(own, factor) AND m44 IS NOT NULL),
  si AS (SELECT co.*, abs(t) >= 2 AND co.n - co.k >= 3 AS significant, r0.m44 AS whole FROM co JOIN r0 USING (product_id))
SELECT product_id, factor, round(beta, 2) + 0.0 AS beta, round(t, 1) + 0.0 AS t, significant, CASE WHEN NOT significant THEN 'none' WHEN abs(beta) >= 0.3 THEN 'high' WHEN abs(beta) >= 0.15 THEN 'medium' ELSE 'low' END AS impact, CASE WHEN beta >= 0 THEN 'up' ELSE 'down' END AS direction, len(own) > 1 AS weather_relevant,
  CASE WHEN whole > 0 THEN round(greatest(0, 1 - m44), 3) ELSE 0 END AS r2, CASE WHEN whole > 0 THEN round(greatest(0, 1 - (1 - greatest(0, 1 - m44)) * (n - 1) / (n - k)), 3) ELSE 0 END AS adj_r2, CAST(n AS INTEGER) AS n FROM si"""
    )


REGRESSION = _regression()
