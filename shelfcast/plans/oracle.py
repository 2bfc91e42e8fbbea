"""The same results as plain SQL over the benchmark tables, to check the queries against."""

from __future__ import annotations

BASE_VIEW = """
    SELECT l_suppkey AS store_id, p_brand AS product_id, l_shipdate AS day,
           l_quantity AS quantity, l_discount AS discount
    FROM lineitem JOIN part ON l_partkey = p_partkey"""

DENSE_VIEW = """
    SELECT c_nationkey AS store_id, p_type AS product_id, l_shipdate AS day,
           l_quantity AS quantity, l_discount AS discount
    FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""

WEEK_START = "CAST(date_trunc('week', CAST({day} AS DATE) - INTERVAL 1 DAY) AS DATE) + 1"


def _with(select: str, view: str = BASE_VIEW, top: int = 50_000, cap: int = 4_000_000, chunk: int = 25, recent: int = 4) -> str:
    return f"""
WITH sales AS ({view}
),
prepared AS (
    SELECT store_id, product_id, {WEEK_START.format(day="day")} AS week_start,
           coalesce(quantity, 0) AS quantity, coalesce(discount, 0) AS discount
    FROM sales WHERE store_id IS NOT NULL AND product_id IS NOT NULL AND day IS NOT NULL
),
weekly AS (
    SELECT store_id, product_id, week_start, sum(quantity) AS quantity, count(quantity) AS trans_count,
           avg(discount) AS discount_mean, max(discount) AS discount_max
    FROM prepared GROUP BY store_id, product_id, week_start
),
bounds AS (SELECT max(week_start) AS max_week, count(DISTINCT week_start) AS n_weeks FROM weekly),
pairs AS (
    SELECT store_id, product_id, max(week_start) AS last_week, sum(quantity) AS total_sales
    FROM weekly GROUP BY store_id, product_id
),
last_sale AS (
    SELECT store_id, product_id, last_week,
           CAST((max_week - last_week) // 7 AS INTEGER) AS weeks_since_sale
    FROM pairs, bounds
),
extinct AS (SELECT store_id, product_id FROM last_sale WHERE weeks_since_sale > 12),
recent AS (SELECT weekly.* FROM weekly, bounds WHERE week_start >= max_week - {7 * recent}),
pair_avg AS (SELECT store_id, product_id, avg(quantity) AS pair_avg FROM recent GROUP BY ALL),
product_avg AS (SELECT product_id, avg(quantity) AS global_avg FROM recent GROUP BY ALL),
product_totals AS (SELECT product_id, sum(quantity) AS total_sales FROM weekly GROUP BY ALL),
selling AS (
    SELECT product_id, count(*) OVER () AS n,
           row_number() OVER (ORDER BY md5('42|' || CAST(product_id AS VARCHAR)), product_id) AS position
    FROM product_totals WHERE total_sales > 0
),
representative AS (SELECT product_id FROM selling WHERE position <= round_even(0.2 * n, 0)),
ranked AS (
    SELECT store_id, product_id, total_sales,
           row_number() OVER (ORDER BY total_sales DESC, store_id, product_id) AS rank
    FROM pairs
),
best AS (SELECT * FROM ranked WHERE rank <= {top}),
top_pairs AS (
    SELECT store_id, product_id, total_sales FROM best, bounds
    WHERE rank <= CASE WHEN (SELECT count(*) FROM best) * n_weeks > {cap}
                       THEN greatest({cap} // n_weeks, 1000) ELSE {top} END
),
active AS (
    SELECT store_id, product_id FROM top_pairs t
    WHERE NOT EXISTS (SELECT 1 FROM extinct e WHERE e.store_id = t.store_id AND e.product_id = t.product_id)
),
selling_still AS (SELECT store_id, product_id FROM last_sale WHERE weeks_since_sale <= 12),
panel_weeks AS (SELECT weekly.* FROM weekly JOIN selling_still USING (store_id, product_id)),
panel_rows AS (
    SELECT panel_weeks.*,
           CAST((week_start - (SELECT min(week_start) FROM panel_weeks)) // 7 AS INTEGER) AS time_idx
    FROM panel_weeks
),
panel AS (
    SELECT *,
           coalesce(lag(quantity, 1) OVER w, 0) AS qty_lag_1,
           coalesce(lag(quantity, 2) OVER w, 0) AS qty_lag_2,
           coalesce(lag(quantity, 3) OVER w, 0) AS qty_lag_3,
           coalesce(lag(quantity, 4) OVER w, 0) AS qty_lag_4,
           coalesce(lag(quantity, 8) OVER w, 0) AS qty_lag_8,
           coalesce(lag(quantity, 12) OVER w, 0) AS qty_lag_12,
           coalesce(lag(quantity, 52) OVER w, 0) AS qty_lag_52,
           sum(quantity) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS qty_4w_sum,
           avg(quantity) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS qty_12w_mean,
           sum(quantity) OVER (PARTITION BY store_id, time_idx) AS store_week_total,
           sum(quantity) OVER (PARTITION BY product_id, time_idx) AS product_global_week,
           lead(quantity, 1) OVER w AS target_h1, lead(quantity, 2) OVER w AS target_h2,
           lead(quantity, 3) OVER w AS target_h3, lead(quantity, 4) OVER w AS target_h4,
           lead(quantity, 5) OVER w AS target_h5,
           row_number() OVER (PARTITION BY store_id, product_id ORDER BY week_start DESC) AS from_end
    FROM panel_rows WINDOW w AS (PARTITION BY store_id, product_id ORDER BY week_start)
),
naive AS (
    SELECT *,
           avg(quantity) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS pred_naive,
           lead(quantity, 1) OVER w AS target_h1, lead(quantity, 2) OVER w AS target_h2,
           lead(quantity, 3) OVER w AS target_h3, lead(quantity, 4) OVER w AS target_h4,
           lead(quantity, 5) OVER w AS target_h5
    FROM weekly WINDOW w AS (PARTITION BY store_id, product_id ORDER BY week_start)
),
metrics AS (
    SELECT h AS horizon, sum(abs(target - pred_naive)) / (sum(abs(target)) + 1e-8) AS wmape, count(target) AS n
    FROM (SELECT 1 AS h, target_h1 AS target, pred_naive FROM naive
          UNION ALL SELECT 2, target_h2, pred_naive FROM naive
          UNION ALL SELECT 3, target_h3, pred_naive FROM naive
          UNION ALL SELECT 4, target_h4, pred_naive FROM naive
          UNION ALL SELECT 5, target_h5, pred_naive FROM naive)
    GROUP BY h
),
store_list AS (SELECT DISTINCT s_suppkey AS store_id FROM supplier WHERE s_suppkey IS NOT NULL),
product_list AS (SELECT DISTINCT p_brand AS product_id FROM part WHERE p_brand IS NOT NULL),
store_codes AS (SELECT store_id, dense_rank() OVER (ORDER BY store_id) AS pdv FROM store_list),
product_codes AS (SELECT product_id, dense_rank() OVER (ORDER BY product_id) AS produto FROM product_list),
chunks AS (SELECT store_id, pdv AS store_code, CAST((pdv - 1) // {chunk} AS INTEGER) AS store_chunk FROM store_codes),
horizons AS (SELECT CAST(h AS INTEGER) AS horizon FROM (VALUES (1), (2), (3), (4), (5)) v(h)),
base_pairs AS (
    SELECT s.store_id, p.product_id, e.store_id IS NOT NULL AS extinct,
           CASE WHEN e.store_id IS NOT NULL THEN 0
                WHEN r.product_id IS NOT NULL AND a.pair_avg IS NOT NULL THEN greatest(0, a.pair_avg)
                ELSE coalesce(g.global_avg, 0) END AS base
    FROM store_list s CROSS JOIN product_list p
    LEFT JOIN extinct e ON e.store_id = s.store_id AND e.product_id = p.product_id
    LEFT JOIN representative r ON r.product_id = p.product_id
    LEFT JOIN pair_avg a ON a.store_id = s.store_id AND a.product_id = p.product_id
    LEFT JOIN product_avg g ON g.product_id = p.product_id
),
base_forecast AS (SELECT store_id, product_id, horizon, base AS prediction FROM base_pairs CROSS JOIN horizons),
stand_in AS (
    SELECT store_id, product_id, horizon,
           CASE WHEN horizon < 5 THEN round(qty_4w_sum / 4, 6) END AS value
    FROM panel CROSS JOIN horizons WHERE from_end = 1
),
coded AS (
    SELECT CAST(pdv AS BIGINT) AS pdv, CAST(produto AS BIGINT) AS produto, CAST(horizon AS SMALLINT) AS semana,
           CAST(greatest(0, round(round(prediction, 6))) AS BIGINT) AS quantidade
    FROM base_forecast JOIN store_codes USING (store_id) JOIN product_codes USING (product_id)
),
chunk_sizes AS (
    SELECT store_chunk, coalesce(sum(n), 0) * 16 AS bytes
    FROM chunks LEFT JOIN (SELECT store_id, count(*) AS n FROM prepared GROUP BY store_id) USING (store_id)
    GROUP BY store_chunk
)
{select}
"""


def _splits() -> str:
    parts = []
    for h in range(1, 6):
        parts.append(
            f"""SELECT CAST({h} AS INTEGER) AS horizon,
       count(*) FILTER (WHERE time_idx <= last - 6 AND target_h{h} IS NOT NULL) AS train_rows,
       count(*) FILTER (WHERE time_idx > last - 6 AND time_idx <= last - {h}
                        AND target_h{h} IS NOT NULL) AS valid_rows
FROM panel, (SELECT max(time_idx) AS last FROM panel)"""
        )
    return "\nUNION ALL\n".join(parts)


def _override(missing: str) -> str:
    return f"""SELECT b.store_id, b.product_id, h.horizon,
       round(CASE WHEN b.extinct THEN 0 WHEN o.store_id IS NOT NULL THEN coalesce(o.value, {missing})
                  ELSE b.base END, 6) AS prediction
FROM base_pairs b CROSS JOIN horizons h
LEFT JOIN stand_in o ON o.store_id = b.store_id AND o.product_id = b.product_id AND o.horizon = h.horizon"""


BASE_FORECAST = _with("SELECT store_id, product_id, horizon, round(prediction, 6) AS prediction FROM base_forecast")
REFRESHED = BASE_FORECAST.replace(
    BASE_VIEW, BASE_VIEW + "\n    WHERE l_suppkey <> (SELECT min(s_suppkey) FROM supplier) OR l_shipdate >= DATE '1998-01-01'"
)
ASKED = _with(
    """SELECT store_id, product_id, horizon, round(prediction, 6) AS prediction
FROM base_forecast JOIN (SELECT DISTINCT store_id, product_id FROM sales) USING (store_id, product_id)"""
)
METRICS = _with("SELECT CAST(horizon AS INTEGER) AS horizon, round(wmape, 6) AS wmape, n FROM metrics")
EXPORT = _with("SELECT pdv, produto, semana, quantidade FROM coded")

ROLLING_ORIGIN = """SELECT * FROM (
WITH origins AS (SELECT max_week - 7 * k AS origin FROM bounds, (VALUES (5), (9), (13)) v(k)),
known AS (SELECT origin, weekly.* FROM weekly JOIN origins ON week_start <= origin),
latest AS (SELECT origin, max(week_start) AS newest FROM known GROUP BY origin),
sold AS (SELECT origin, store_id, product_id, max(week_start) AS last_week FROM known GROUP BY ALL),
lately AS (SELECT known.* FROM known JOIN latest USING (origin) WHERE week_start >= newest - 28),
own AS (SELECT origin, store_id, product_id, avg(quantity) AS a FROM lately GROUP BY ALL),
of_product AS (SELECT origin, product_id, avg(quantity) AS g FROM lately GROUP BY ALL),
sums AS (SELECT origin, product_id, sum(quantity) AS total FROM known GROUP BY ALL),
places AS (
    SELECT origin, product_id, count(*) OVER (PARTITION BY origin) AS n,
           row_number() OVER (PARTITION BY origin ORDER BY md5('42|' || CAST(product_id AS VARCHAR)), product_id) AS place
    FROM sums WHERE total > 0
),
later AS (
    SELECT origin, store_id, product_id, CAST((week_start - origin) // 7 AS INTEGER) AS horizon, quantity
    FROM weekly, origins WHERE week_start > origin AND week_start <= origin + 35
),
made AS (
    SELECT l.horizon, l.quantity,
           CASE WHEN NOT EXISTS (SELECT 1 FROM known k WHERE k.origin = l.origin AND k.store_id = l.store_id) THEN 0
                WHEN (t.newest - s.last_week) // 7 > 12 THEN 0
                WHEN p.place <= round_even(0.2 * p.n, 0) AND a IS NOT NULL THEN greatest(0, a)
                ELSE coalesce(g, 0) END AS prediction
    FROM later l JOIN latest t ON t.origin = l.origin
    LEFT JOIN sold s ON s.origin = l.origin AND s.store_id = l.store_id AND s.product_id = l.product_id
    LEFT JOIN own o ON o.origin = l.origin AND o.store_id = l.store_id AND o.product_id = l.product_id
    LEFT JOIN of_product g ON g.origin = l.origin AND g.product_id = l.product_id
    LEFT JOIN places p ON p.origin = l.origin AND p.product_id = l.product_id
)
SELECT horizon, round(sum(abs(quantity - prediction)) / (sum(abs(quantity)) + 1e-8), 6) AS wmape, count(*) AS n
FROM made GROUP BY horizon)"""

PREPARED_LENIENT = f"""
WITH text AS (
    SELECT l_suppkey AS store_id, l_partkey AS product_id,
           CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'unknown'
                ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day,
           CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS VARCHAR) || ' pcs'
                ELSE CAST(l_quantity AS VARCHAR) END AS quantity
    FROM lineitem
)
SELECT store_id, product_id, {WEEK_START.format(day="TRY_CAST(day AS DATE)")} AS week_start,
       coalesce(TRY_CAST(quantity AS DOUBLE), 0) AS quantity, CAST(0 AS DOUBLE) AS discount
FROM text WHERE store_id IS NOT NULL AND product_id IS NOT NULL AND TRY_CAST(day AS DATE) IS NOT NULL
"""

PREPARED_DATES = f"""
WITH text AS (
    SELECT l_suppkey AS store_id, l_partkey AS product_id, CAST(l_quantity AS DOUBLE) AS quantity,
           CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 2 THEN strftime(l_shipdate, '%Y%m%d')
                WHEN 3 THEN strftime(l_shipdate, '%m/%d/%Y') WHEN 4 THEN strftime(l_shipdate, '%b %-d, %Y')
                WHEN 5 THEN strftime(l_shipdate, '%-m/%-d/%Y') ELSE 'not known' END AS day_text
    FROM lineitem
),
read AS (
    SELECT *, CAST(try_strptime(day_text, ['%Y-%m-%d', '%Y%m%d', '%m/%d/%Y', '%b %d, %Y']) AS DATE) AS day FROM text
)
SELECT store_id, product_id, {WEEK_START.format(day="day")} AS week_start,
       coalesce(quantity, 0) AS quantity, CAST(0 AS DOUBLE) AS discount
FROM read WHERE store_id IS NOT NULL AND product_id IS NOT NULL AND day IS NOT NULL
"""


# The 15 features of the panel.
FEATURE_COLUMNS = (
    "discount_mean discount_max trans_count qty_4w_sum qty_12w_mean store_week_total product_global_week time_idx "
    "qty_lag_1 qty_lag_2 qty_lag_3 qty_lag_4 qty_lag_8 qty_lag_12 qty_lag_52"
).split()

FINITE_GUARD = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber <= 4 THEN 0 ELSE round(greatest(0, CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE)), 6) END AS guarded
FROM lineitem"""


def oracle_sql() -> dict[str, str]:
    week = "store_id, product_id, week_start"
    return {
        "prepared_transactions": _with(f"SELECT {week}, quantity, discount FROM prepared"),
        "prepared_lenient": PREPARED_LENIENT,
        "prepared_dates": PREPARED_DATES,
        "universe_stores": _with("SELECT store_id FROM store_list"),
        "universe_products": _with("SELECT product_id FROM product_list"),
        "reading_counts": _with(
            """SELECT (SELECT count(*) FROM sales) AS transactions_read,
       (SELECT count(*) FROM sales) - (SELECT count(*) FROM prepared) AS transactions_left_out"""
        ),
        "weekly_sales": _with(
            f"SELECT {week}, quantity, trans_count, round(discount_mean, 6) AS discount_mean, discount_max FROM weekly"
        ),
        "pair_last_sale": _with("SELECT store_id, product_id, last_week, weeks_since_sale FROM last_sale"),
        "extinct_pairs": _with("SELECT store_id, product_id FROM extinct"),
        "recent_product_avg": _with("SELECT product_id, round(global_avg, 6) AS global_avg FROM product_avg"),
        "recent_pair_avg": _with("SELECT store_id, product_id, round(pair_avg, 6) AS pair_avg FROM pair_avg"),
        "product_totals": _with("SELECT product_id, total_sales FROM product_totals"),
        "representative_products": _with("SELECT product_id FROM representative"),
        "distinct_weeks": _with("SELECT n_weeks FROM bounds"),
        "top_pairs": _with("SELECT store_id, product_id, total_sales FROM top_pairs", top=200),
        "top_pairs_capped": _with("SELECT store_id, product_id, total_sales FROM top_pairs", cap=400_000),
        "top_pairs_active": _with("SELECT store_id, product_id FROM active"),
        "panel_time_idx": _with(f"SELECT {week}, quantity, time_idx FROM panel_rows"),
        "panel_lags": _with(
            f"""SELECT {week}, qty_lag_1, qty_lag_2, qty_lag_3, qty_lag_4, qty_lag_8, qty_lag_12, qty_lag_52
FROM panel"""
        ),
        "panel_rolling": _with(f"SELECT {week}, qty_4w_sum, round(qty_12w_mean, 6) AS qty_12w_mean FROM panel"),
        "panel_totals": _with(f"SELECT {week}, store_week_total, product_global_week FROM panel"),
        "panel_targets": _with(
            f"SELECT {week}, target_h1, target_h2, target_h3, target_h4, target_h5 FROM panel"
        ),
        "split_counts": _with(_splits(), view=DENSE_VIEW),
        "pair_last_point": _with(
            f"""SELECT {week}, time_idx, quantity, qty_4w_sum, round(qty_12w_mean, 6) AS qty_12w_mean
FROM panel WHERE from_end = 1"""
        ),
        "naive_forecast": _with(f"SELECT {week}, round(pred_naive, 6) AS pred_naive FROM naive"),
        "backtest_wmape": METRICS,
        "rolling_origin_wmape": _with(ROLLING_ORIGIN),
        "chunk_ids": _with("SELECT store_id, store_code, store_chunk FROM chunks"),
        "base_forecast_pairs": _with(
            "SELECT store_id, product_id, extinct, round(base, 6) AS base FROM base_pairs"
        ),
        "base_forecast": BASE_FORECAST,
        "override_rows": _with(
            "SELECT store_id, product_id, horizon, coalesce(value, 0) AS prediction FROM stand_in"
        ),
        "override_apply": _with(_override("0")),
        "override_keep_base": _with(_override("b.base")),
        "store_codes": _with("SELECT store_id, pdv FROM store_codes"),
        "product_codes": _with("SELECT product_id, produto FROM product_codes"),
        "export_layout": EXPORT,
        "export_head": _with(
            "SELECT pdv, produto, semana, quantidade FROM coded ORDER BY pdv, produto, semana LIMIT 1000"
        ),
        "size_capped_prefix": _with(
            """SELECT store_chunk, CAST(bytes AS BIGINT) AS bytes, CAST(total_bytes AS BIGINT) AS total_bytes
FROM (SELECT *, sum(bytes) OVER (ORDER BY store_chunk) AS total_bytes,
             row_number() OVER (ORDER BY store_chunk) AS n FROM chunk_sizes)
WHERE total_bytes <= 500000 OR n = 1"""
        ),
        "run_summary": _with(
            """SELECT (SELECT count(*) FROM store_list) AS n_stores, (SELECT count(*) FROM product_list) AS n_products,
       (SELECT count(*) FROM extinct) AS extinct_pairs,
       (SELECT count(*) FROM representative) AS representative_products,
       (SELECT count(*) FROM active) AS top_pairs,
       (SELECT count(*) FROM store_list) * (SELECT count(*) FROM product_list) * 5 AS expected_predictions"""
        ),
        "full_run": BASE_FORECAST,
        "full_run_csv": BASE_FORECAST,
        "full_run_dense": BASE_FORECAST,
        "asked_forecast": ASKED,
        "asked_pairs": ASKED,
        "recent_pair_avg_long": _with("SELECT store_id, product_id, round(pair_avg, 6) AS pair_avg FROM pair_avg", recent=80),
        "metrics_csv": METRICS,
        "resume_pending": _with("SELECT DISTINCT store_chunk FROM chunks WHERE store_chunk >= 3"),
        "resumed_run": BASE_FORECAST,
        "export_files": EXPORT,
        "export_head_file": _with(
            "SELECT pdv, produto, semana, quantidade FROM coded ORDER BY pdv, produto, semana LIMIT 1000"
        ),
        "export_replaced": _with("SELECT pdv, produto, semana, quantidade FROM coded WHERE semana <= 3"),
        "export_row_groups": _with(
            "SELECT 'gzip' AS codec, count(*) AS n_rows, least(count(*), 1000) AS largest_group FROM coded"
        ),
        "export_capped_prefix": _with("SELECT pdv, produto, semana, quantidade FROM coded WHERE pdv <= 6"),
        "chunk_files": _with(
            """SELECT store_chunk, store_id, product_id, horizon, round(prediction, 6) AS prediction
FROM base_forecast JOIN chunks USING (store_id) WHERE store_chunk % 2 = 0""",
            chunk=3,
        ),
        "required_columns": _with(
            "\nUNION ALL\n".join(
                f"""SELECT '{name}' AS dropped, 'transactions lack the columns [''{name}'']' AS reported, count({column}) AS n_values
FROM sales"""
                for name, column in (("store_id", "store_id"), ("product_id", "product_id"), ("transaction_date", "day"), ("quantity", "quantity"))
            )
        ),
        "feature_totals": _with(
            "\nUNION ALL\n".join(
                f"SELECT '{f}' AS feature, count({f}) AS n, CAST(round(sum({f}), 2) AS DOUBLE) AS total FROM panel" for f in FEATURE_COLUMNS
            )
        ),
        "finite_guard": FINITE_GUARD,
        "scored_last_points": _with(
            """SELECT store_id, product_id, horizon,
       CASE WHEN horizon > 2 THEN NULL
            ELSE greatest(0, 1 + CASE WHEN qty_4w_sum > 60 THEN 3 ELSE -5 END
                 + CASE WHEN horizon = 1 THEN 0 WHEN qty_lag_1 > 20 THEN 6.5 ELSE 0.25 END) END::DOUBLE AS prediction
FROM panel CROSS JOIN horizons WHERE from_end = 1"""
        ),
        "refreshed_run": REFRESHED,
        "refreshed_chunks": f"""
SELECT DISTINCT CAST((pdv - 1) // 3 AS INTEGER) AS store_chunk
FROM (SELECT s_suppkey AS store_id, dense_rank() OVER (ORDER BY s_suppkey) AS pdv FROM supplier)
JOIN (SELECT * FROM ({BASE_FORECAST}) EXCEPT SELECT * FROM ({REFRESHED})) USING (store_id)""",
        "rerun_other_input": BASE_FORECAST.replace(BASE_VIEW, BASE_VIEW + "\n    WHERE l_shipdate < DATE '1998-01-01'"),
    }
