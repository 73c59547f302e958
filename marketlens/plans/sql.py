"""Common table expressions that stand for the inputs, for the jobs' SQL."""

PARTS = {
    "ord": """SELECT o.o_orderkey AS order_sn, o.o_custkey AS buyer, CAST(o.o_orderdate AS DATE) AS d, b.brand_id
      FROM orders o LEFT JOIN (SELECT l_orderkey, min(p_brand) AS brand_id FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) b ON b.l_orderkey = o.o_orderkey
      WHERE o.o_orderstatus = 'F'""",
    "paid": "SELECT l_orderkey AS order_sn, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS INTEGER)) AS spend FROM lineitem GROUP BY 1",
    "base": """SELECT buyer, count(DISTINCT order_sn) AS orders, sum(spend) AS spend, min(d) AS first_order, max(d) AS last_order,
      coalesce(string_agg(DISTINCT brand_id, ', ' ORDER BY brand_id), '') AS brands, CAST((SELECT max(d) FROM ord) - max(d) AS INTEGER) AS recency
      FROM ord JOIN paid USING (order_sn) GROUP BY 1""",
    "sales": """SELECT CAST(CAST(l_shipdate AS DATE) + INTERVAL 24 YEAR AS DATE) AS date, l_returnflag AS platform, p_brand AS brand, p_partkey AS product_id, p_name AS product_name,
      CAST(l_quantity AS DECIMAL(18,2)) AS units, CAST(l_extendedprice AS DECIMAL(18,2)) AS gmv FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fin": "SELECT CAST(CAST(o_orderdate AS DATE) + INTERVAL 24 YEAR AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS net_sales FROM orders",
    "bd": "SELECT brand AS product_id, date, CAST(sum(units) AS DOUBLE) AS units, CAST(sum(gmv) AS DOUBLE) AS gmv FROM sales GROUP BY 1, 2",
    "bs": "SELECT p_brand AS product_id, CAST(CASE WHEN count(*) % 7 = 0 THEN NULL ELSE (sum(p_size) * 3) % 2500 END AS DOUBLE) AS stock FROM part GROUP BY 1",
    "dense": """SELECT k.product_id, CAST(k.day AS DATE) AS date, coalesce(b.units, 0) AS units, coalesce(b.gmv, 0) AS gmv
      FROM (SELECT product_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM bd GROUP BY 1) k
      LEFT JOIN bd b ON b.product_id = k.product_id AND b.date = CAST(k.day AS DATE)""",
    "com": """SELECT doc_id AS comment_id, ts AS created_at, user_id AS username, doc_id AS buyer, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END AS brand,
      CASE WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(doc_id % 50 AS VARCHAR) END AS product_name, CAST(CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1 + (doc_id * 7) % 5 END AS DOUBLE) AS rating,
      text AS comment, doc_id % 3 = 0 AS has_image, CASE WHEN doc_id % 4 = 0 THEN 'shop' ELSE CAST(doc_id % 9 AS VARCHAR) END AS shop_id, CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'in_progress' ELSE 'resolved' END AS status FROM documents LEFT JOIN events ON doc_id = event_id""",
    "prod": """SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS brand, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
      CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 't' || p_partkey END AS thumbnail_url, 'i' || p_partkey AS image_url FROM part""",
    "env": """SELECT date, round(s / n / 1000, 1) AS pm2_5, 20 + n AS temp_mean, round(s % 50, 1) AS precip
      FROM (SELECT date, CAST(sum(net_sales) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM fin GROUP BY 1)""",
}
NEEDS = {"base": ["ord", "paid"], "bd": ["sales"], "dense": ["bd"], "env": ["fin"], "lab": ["com"], "dt": ["lab"], "weekly": ["dense"]}


def sql(body: str, *parts: str) -> str:
    """``body`` after the common table expressions it names."""
    order: list[str] = []

    def add(p: str) -> None:
        for q in NEEDS.get(p, []):
            add(q)
        if p not in order:
            order.append(p)

    for p in parts:
        add(p)
    head = "WITH " + ",\n".join(f"{p} AS ({PARTS[p]})" for p in order)
    return head + ("" if body.lstrip().startswith(",") else "\n") + body
