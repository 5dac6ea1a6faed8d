"""SQL statements the queries are checked against, written for DuckDB.

Plain textbook SQL: windows, joins and self-contained formulas, with none of the tricks the Spark
side uses to stay spread out.
"""

from __future__ import annotations

from checks.bindings import RAW_SPELLING
from salesloom import fixed
from salesloom.operators import narrative


def rnd(expr: str, digits: int = 0) -> str:
    """Half-up rounding on the decimal value."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def whole(expr: str) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,8)), 0) AS BIGINT)"


def words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_KIND = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RAW_SPELLING.items()) + " END"


def std(col: str) -> str:
    return "CASE " + " ".join(
        f"WHEN trim({col}) IN {words(w)} THEN '{name}'" for name, w in fixed.CATEGORY_SPELLINGS.items()
    ) + f" ELSE trim({col}) END"


_SQL_FORMATS = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y-%m", "%Y/%m", "%Y.%m", "%Y年%m月", "%Y年%m月%d日",
                "%m/%d/%Y", "%d/%m/%Y"]


def day(col: str) -> str:
    return "CAST(coalesce(" + ", ".join(f"try_strptime(trim({col}), '{f}')" for f in _SQL_FORMATS) + ") AS DATE)"


FACTS = f"""facts AS (
  SELECT l_orderkey, l_linenumber, p_brand AS brand, p_name AS model, l_quantity AS sales_volume,
         floor(l_extendedprice / 10 + 0.5) / 100 AS sales_price, {_KIND} AS energy_type,
         CASE l_linenumber % 3
           WHEN 0 THEN concat(year(l_shipdate), '/', month(l_shipdate), '/', day(l_shipdate))
           WHEN 1 THEN concat(year(l_shipdate), '年', month(l_shipdate), '月')
           ELSE concat(year(l_shipdate), '-', month(l_shipdate), '-', day(l_shipdate)) END AS sale_date
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

RAW = FACTS + """, dirty AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 301 = 0 THEN 'unknown' ELSE brand END AS brand,
         model,
         CASE WHEN (l_orderkey + l_linenumber) % 101 = 0 THEN 'abc' ELSE CAST(sales_volume AS VARCHAR) END
           AS sales_volume,
         CASE WHEN l_orderkey % 89 = 0 THEN NULL WHEN l_orderkey % 211 = 0 THEN sales_price * 50
              ELSE sales_price END AS sales_price,
         energy_type, sale_date
  FROM facts), raw AS (
  SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE l_orderkey % 50 = 0)"""

NUM = RAW + """, coerced AS (
  SELECT l_orderkey, l_linenumber, brand, model, TRY_CAST(sales_volume AS DOUBLE) AS sales_volume,
         sales_price, energy_type, sale_date FROM raw), num AS (SELECT DISTINCT * FROM coerced)"""

VEHICLES = FACTS + f""", vehicles AS (
  SELECT o_custkey AS user_id, l_orderkey AS upload_id, brand, model,
         CAST(sales_volume AS BIGINT) AS sales_volume, sales_price, {std('energy_type')} AS energy_type,
         {day('sale_date')} AS sale_date
  FROM facts JOIN orders ON l_orderkey = o_orderkey)"""

UPLOADS = """uploads AS (
  SELECT o_orderkey AS upload_id, o_custkey AS user_id, concat('order-', o_orderkey, '.csv') AS filename,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS record_count, CAST(o_orderdate AS DATE) AS created_at
  FROM orders)"""

USERS = """users AS (
  SELECT c_custkey AS user_id, c_name AS username,
         CAST(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS DATE) AS created_at,
         CASE WHEN c_acctbal >= 0 THEN (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) END
           AS active_upload_id
  FROM customer)"""

TENANTS = f"{VEHICLES}, {UPLOADS}, {USERS}"

_MODE = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def mode(col: str, table: str = "num") -> str:
    return _MODE.format(c=col, t=table)


AUTO = NUM + f""", filled AS (
  SELECT l_orderkey, l_linenumber, coalesce(brand, {mode('brand')}) AS brand, model,
         coalesce(sales_volume, (SELECT median(sales_volume) FROM num)) AS sales_volume,
         coalesce(sales_price, (SELECT median(sales_price) FROM num)) AS sales_price,
         energy_type, sale_date FROM num), stats AS (
  SELECT count(*) AS n, avg(sales_volume) AS va, stddev_pop(sales_volume) AS vs, median(sales_volume) AS vm,
         avg(sales_price) AS pa, stddev_pop(sales_price) AS ps, median(sales_price) AS pm FROM filled), flagged AS (
  SELECT f.*, abs(sales_volume - va) / vs > 3 AS v_out, abs(sales_price - pa) / ps > 3 AS p_out, vm, pm
  FROM filled f, stats), repaired AS (
  SELECT l_orderkey, l_linenumber, brand, model, CASE WHEN v_out THEN vm ELSE sales_volume END AS sales_volume,
         CASE WHEN p_out THEN pm ELSE sales_price END AS sales_price, {std('energy_type')} AS energy_type,
         {day('sale_date')} AS sale_date, v_out, p_out FROM flagged), clean AS (
  SELECT * EXCLUDE (v_out, p_out) FROM repaired
  WHERE brand NOT IN {words(fixed.INVALID_NAMES)} AND model NOT IN {words(fixed.INVALID_NAMES)})"""

ROW = "l_orderkey, l_linenumber, brand, model, {v}, {p}, energy_type"


def row(v: str = "sales_volume", p: str = "sales_price", extra: str = "") -> str:
    return (f"l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, brand, model, "
            f"{rnd(v, 4)} AS sales_volume, {rnd(p, 4)} AS sales_price, energy_type{extra}")


def shares(total: str = "sum(sales_volume)") -> list[str]:
    return [
        rnd(f"coalesce(sum(CASE WHEN energy_type IN {words(w)} THEN sales_volume END), 0) * 100.0 / nullif({total}, 0)", 1)
        for w in fixed.SHARE_SPELLINGS.values()
    ]


def overview(by: str) -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = (lambda t: f"JOIN {t} USING ({by})") if by else (lambda t: f"CROSS JOIN {t}")
    oil, electric, hybrid = shares()
    return f"""WITH {VEHICLES}, head AS (
  SELECT {key} count(*) AS total_rows, {rnd('avg(sales_price)', 2)} AS avg_price,
         count(DISTINCT brand) AS dim_count, {oil} AS oil_ratio, {electric} AS electric_ratio,
         {hybrid} AS hybrid_ratio FROM vehicles {group}), q AS (
  SELECT {key} brand, model, sales_volume, sales_volume * sales_price AS revenue,
         row_number() OVER ({part}ORDER BY sales_volume DESC, brand, model) AS a,
         row_number() OVER ({part}ORDER BY sales_volume * sales_price DESC, brand, model) AS b FROM vehicles),
  car AS (SELECT {key} concat(brand, ' ', model) AS top_volume_name, sales_volume AS top_volume FROM q WHERE a = 1),
  money AS (SELECT {key} concat(brand, ' ', model) AS top_revenue_name, {rnd('revenue', 2)} AS top_revenue
            FROM q WHERE b = 1),
  items AS (SELECT {key} model AS top_item_by_rows,
            row_number() OVER ({part}ORDER BY count(*) DESC, model) AS k FROM vehicles GROUP BY {key} model),
  dims AS (SELECT {key} brand AS top_dim_by_rows,
           row_number() OVER ({part}ORDER BY count(*) DESC, brand) AS k FROM vehicles GROUP BY {key} brand)
SELECT {key} total_rows, top_volume_name, top_volume, top_revenue_name, top_revenue, top_item_by_rows,
       top_dim_by_rows, avg_price, dim_count, oil_ratio, electric_ratio, hybrid_ratio
FROM head {join('car')} {join('money')} {join('(SELECT * EXCLUDE (k) FROM items WHERE k = 1)')}
     {join('(SELECT * EXCLUDE (k) FROM dims WHERE k = 1)')}"""


def _bins(bins, start: int = 0) -> str:
    return ", ".join(
        f"({i}, '{label}', CAST({lo} AS DOUBLE), CAST({'NULL' if hi is None else hi} AS DOUBLE))"
        for i, (label, lo, hi) in enumerate(bins, start)
    )


def histogram(by: str) -> str:
    key = f"{by}, " if by else ""
    keys = f"(SELECT DISTINCT {by} FROM vehicles) k, " if by else ""
    on = f"v.{by} = k.{by} AND " if by else ""
    head = f"k.{by}, " if by else ""
    return f"""WITH {VEHICLES}, bins(bin, label, lo, hi) AS (VALUES {_bins(fixed.PRICE_BINS)}),
 grid AS (SELECT {head} bin, label, lo, hi FROM {keys} bins)
SELECT {key.replace('user_id', 'k.user_id') if by else ''} CAST(bin AS BIGINT) AS bin, label, lo, hi,
       count(v.brand) AS "rows"
FROM grid k LEFT JOIN vehicles v ON {on} v.sales_price >= lo AND (hi IS NULL OR v.sales_price < hi)
GROUP BY ALL"""


VALID = "sales_price > 0 AND sales_volume > 0"

# closed form of the 3 x 3 regression: Cramer's rule on centred second moments
_FEATURES = f"""feats AS (
  SELECT user_id, brand, model, sales_price AS x0, CASE WHEN contains(energy_type, '电') THEN 1.0 ELSE 0.0 END AS x1,
         CASE WHEN contains(energy_type, '混') OR contains(energy_type, 'DM') OR contains(energy_type, 'PHEV')
              THEN 1.0 ELSE 0.0 END AS x2, CAST(sales_volume AS DOUBLE) AS y
  FROM vehicles WHERE {VALID})"""


def _moments(source: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    g = f"GROUP BY {key}" if key else ""
    return f"""SELECT {k} count(*) AS n, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
  stddev_pop(x0) AS d0, stddev_pop(x1) AS d1, stddev_pop(x2) AS d2,
  covar_pop(x0, x0) AS a, covar_pop(x0, x1) AS b, covar_pop(x0, x2) AS c, covar_pop(x1, x1) AS d,
  covar_pop(x1, x2) AS e, covar_pop(x2, x2) AS f,
  covar_pop(x0, y) AS p, covar_pop(x1, y) AS q, covar_pop(x2, y) AS r FROM {source} {g}"""


def _solved(source: str) -> str:
    det = "(a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c))"
    return f"""SELECT *,
  (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / {det} AS w0,
  (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / {det} AS w1,
  (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / {det} AS w2 FROM {source}"""


MODEL = f"""{VEHICLES}, {_FEATURES}, mom AS ({_moments('feats')}), sol AS ({_solved('mom')}), model AS (
  SELECT *, my - w0 * m0 - w1 * m1 - w2 * m2 AS w FROM sol), scored AS (
  SELECT y, w + w0 * x0 + w1 * x1 + w2 * x2 AS yhat, my, n FROM feats, model), metric AS (
  SELECT 1 - sum((y - yhat) ** 2) / sum((y - my) ** 2) AS r2, sqrt(avg((y - yhat) ** 2)) AS rmse,
         avg(abs(y - yhat)) AS mae FROM scored)"""

FOLDED = f"""{VEHICLES}, {_FEATURES}, folded AS (
  SELECT *, ntile(5) OVER (ORDER BY brand, model, x0, y, x1, x2) - 1 AS fold FROM feats)"""

_CENTRES = [(20.0, 12.0), (55.0, 40.0), (85.0, 25.0)]
_SCALE = (29.0, 14.0)


def _distance(i: int) -> str:
    (cx, cy), (sx, sy) = _CENTRES[i], _SCALE
    return f"(((sales_price - {cx}) / {sx}) ** 2 + ((sales_volume - {cy}) / {sy}) ** 2)"


CLUSTERED = f"""{VEHICLES}, dist AS (
  SELECT *, {_distance(0)} AS e0, {_distance(1)} AS e1, {_distance(2)} AS e2 FROM vehicles), assigned AS (
  SELECT * EXCLUDE (e0, e1, e2), CAST(CASE WHEN e0 <= e1 AND e0 <= e2 THEN 0 WHEN e1 <= e2 THEN 1 ELSE 2 END AS BIGINT)
         AS cluster FROM dist)"""

_RANKS = """ranked AS (
  SELECT {k} rank() OVER ({p}ORDER BY x) + (count(*) OVER ({p2}x) - 1) / 2.0 AS rx,
         rank() OVER ({p}ORDER BY y) + (count(*) OVER ({p2}y) - 1) / 2.0 AS ry FROM xy)"""


def ranks(by: str) -> str:
    p = f"PARTITION BY {by} " if by else ""
    p2 = f"PARTITION BY {by}, " if by else "PARTITION BY "
    return _RANKS.format(k=f"{by}, " if by else "", p=p, p2=p2)


def xy(by: str = "") -> str:
    k = f"{by}, " if by else ""
    return f"xy AS (SELECT {k} sales_price AS x, CAST(sales_volume AS DOUBLE) AS y FROM vehicles WHERE {VALID})"


def stratum(name: str, flag: str = "energy_type") -> str:
    return f"{flag} = '{name}'"


STRENGTH = """CASE WHEN abs(r) >= 0.8 THEN concat('强', s) WHEN abs(r) >= 0.5 THEN concat('中等', s)
  WHEN abs(r) >= 0.3 THEN concat('弱', s) ELSE '几乎无线性相关' END"""


def _report() -> str:
    """Report text of every customer, by replacing the named places of the wording."""
    fields = {
        "total": "total_rows", "dims": "dim_count", "top_car": "top_volume_name", "top_item": "top_item_by_rows",
        "top_dim": "top_dim_by_rows", "leaders": "leaders", "prices": "prices", "avg_price": "avg_price",
        "oil": "oil_ratio", "electric": "electric_ratio", "hybrid": "hybrid_ratio", "trend": "trend", "advice": "advice",
    }
    text = f"'{narrative.REPORT}'"
    for name, column in fields.items():
        text = f"replace({text}, '{{{name}}}', CAST({column} AS VARCHAR))"
    share = rnd("electric_ratio + hybrid_ratio", 1)
    return f"""WITH {VEHICLES}, h AS ({overview('user_id')}), s AS (
  SELECT user_id, brand, sum(sales_volume) AS v,
         row_number() OVER (PARTITION BY user_id ORDER BY sum(sales_volume) DESC, brand) AS k
  FROM vehicles GROUP BY 1, 2), l AS (
  SELECT user_id, string_agg(concat(brand, '(', v, '辆)'), ', ' ORDER BY k) AS leaders FROM s WHERE k <= 5 GROUP BY 1),
  b AS ({histogram('user_id')}), p AS (
  SELECT user_id, string_agg(concat(label, '(', "rows", '款)'), ', ' ORDER BY bin) AS prices FROM b WHERE "rows" > 0
  GROUP BY 1), t AS (
  SELECT *, CASE WHEN {share} > {narrative.TREND_LIMIT}
      THEN replace('{narrative.TREND_ELECTRIC}', '{{pct}}', CAST({share} AS VARCHAR)) ELSE '{narrative.TREND_FUEL}' END AS trend,
    CASE WHEN {share} < {narrative.ADVICE_LIMIT} THEN '{narrative.ADVICE_EARLY}' ELSE '{narrative.ADVICE_LATE}' END AS advice
  FROM h JOIN l USING (user_id) JOIN p USING (user_id))
SELECT c_custkey AS user_id, total_rows IS NOT NULL AS success,
       CASE WHEN total_rows IS NULL THEN '{fixed.MSG_UPLOAD_FIRST}' END AS message, {text} AS report
FROM customer LEFT JOIN t ON c_custkey = t.user_id"""


#: Printed p-value.
P_TEXT = "CASE WHEN p < 0.001 THEN '<0.001' ELSE CAST(round(round(p, 8), 4) AS VARCHAR) END"


def p_values(table: str, key: str, steps: int) -> str:
    """Table ``{table}_p`` with ``p`` for rows ``(key, n, r)``: the density of r integrated by Simpson's rule over its angle."""
    area = ("sum((CASE WHEN i IN (0, {s}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
            "pow(cos({lo} + i * (pi() / 2 - {lo}) / {s}), n - 3)) * (pi() / 2 - {lo})")
    lo = "asin(least(abs(r), 1))"
    return f"""{table}_p AS (
      SELECT t.*, {key if key.startswith("'") or "," not in key else "NULL"} AS k, (SELECT {area.format(s=steps, lo=lo)} / ({area.format(s=steps, lo='0')})
        FROM range(0, {steps + 1}) g(i)) AS p FROM {table} t)"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    oil, electric, hybrid = shares()
    # ------------------------------------------------------------ cleaning steps
    o["numeric_coercion"] = f"WITH {NUM} SELECT {row()} FROM coerced"
    o["exact_dedup"] = f"WITH {NUM} SELECT {row(extra=', sale_date')} FROM num"
    o["dedup_report"] = f"""WITH {NUM} SELECT a.n AS original_rows, b.n AS distinct_rows, a.n - b.n AS duplicates_removed
      FROM (SELECT count(*) AS n FROM coerced) a, (SELECT count(*) AS n FROM num) b"""
    o["dedup_report_by_model"] = f"""WITH {NUM} SELECT model, a.n AS original_rows, b.n AS distinct_rows,
      a.n - b.n AS duplicates_removed FROM (SELECT model, count(*) AS n FROM coerced GROUP BY 1) a
      JOIN (SELECT model, count(*) AS n FROM num GROUP BY 1) b USING (model)"""
    med = "coalesce({c}, (SELECT median({c}) FROM num), 0)"
    o["median_fill"] = f"WITH {NUM} SELECT {row(med.format(c='sales_volume'), med.format(c='sales_price'))} FROM num"
    o["median_fill_by_model"] = f"""WITH {NUM}, m AS (SELECT model, median(sales_volume) AS mv, median(sales_price) AS mp
      FROM num GROUP BY 1) SELECT {row('coalesce(sales_volume, mv, 0)', 'coalesce(sales_price, mp, 0)')}
      FROM num JOIN m USING (model)"""
    o["mode_fill"] = f"""WITH {NUM} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      coalesce(brand, {mode('brand')}) AS brand, model, energy_type FROM num"""
    o["mode_fill_by_model"] = f"""WITH {NUM}, m AS (SELECT model, brand AS mb,
      row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, brand) AS k FROM num WHERE brand IS NOT NULL
      GROUP BY model, brand) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      coalesce(brand, mb, '未知') AS brand, num.model, energy_type FROM num LEFT JOIN m ON num.model = m.model AND k = 1"""
    o["mode_fill_date_text"] = f"""WITH {FACTS}, gaps AS (SELECT l_orderkey, l_linenumber,
      CASE WHEN l_orderkey % 83 <> 0 THEN sale_date END AS sale_date FROM facts)
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      coalesce(sale_date, {mode('sale_date', 'gaps')}, '2024-01') AS sale_date FROM gaps"""
    z = """abs({c} - {t}.a) / nullif({t}.s, 0) > 3 AND {t}.n > 3"""
    o["zscore_repair"] = f"""WITH {NUM}, sv AS (SELECT avg(sales_volume) a, stddev_pop(sales_volume) s, count(*) n,
      median(sales_volume) m FROM num), sp AS (SELECT avg(sales_price) a, stddev_pop(sales_price) s, count(*) n,
      median(sales_price) m FROM num), fl AS (SELECT num.*, coalesce({z.format(c='sales_volume', t='sv')}, false) AS vo,
      coalesce({z.format(c='sales_price', t='sp')}, false) AS po, sv.m AS vm, sp.m AS pm FROM num, sv, sp)
      SELECT {row('CASE WHEN vo THEN vm ELSE sales_volume END', 'CASE WHEN po THEN pm ELSE sales_price END',
                  ', vo AS sales_volume_outlier, po AS sales_price_outlier')} FROM fl"""
    o["zscore_repair_events"] = f"""WITH st AS (SELECT event_type, avg(value) a, stddev_pop(value) s, count(*) n,
      median(value) m FROM events GROUP BY 1) SELECT event_id, event_type,
      {rnd('CASE WHEN abs(value - a) / nullif(s, 0) > 3 AND n > 3 THEN m ELSE value END', 4)} AS value,
      coalesce(abs(value - a) / nullif(s, 0) > 3 AND n > 3, false) AS value_outlier
      FROM events JOIN st USING (event_type)"""
    o["range_repair"] = f"""WITH {NUM}, m AS (SELECT median(sales_price) AS mp FROM num)
      SELECT {row(p='CASE WHEN sales_price < 5 OR sales_price > 95 THEN mp ELSE sales_price END')} FROM num, m"""
    o["category_standard"] = f"""WITH {FACTS} SELECT energy_type AS spelling, {std('energy_type')} AS energy_type,
      count(*) AS "rows" FROM facts GROUP BY 1, 2"""
    o["date_parse"] = f"""WITH {FACTS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, sale_date AS text,
      {day('sale_date')} AS sale_date FROM facts"""
    o["invalid_entity_filter"] = f"""WITH {NUM} SELECT {row()} FROM num
      WHERE coalesce(brand NOT IN {words(fixed.INVALID_NAMES)}, true)
        AND coalesce(model NOT IN {words(fixed.INVALID_NAMES)}, true)"""
    anynull = "brand IS NULL OR model IS NULL OR sales_volume IS NULL OR sales_price IS NULL OR energy_type IS NULL"
    o["drop_missing"] = f"WITH {NUM} SELECT {row()} FROM num WHERE NOT ({anynull})"
    o["missing_counts"] = f"""WITH {NUM} SELECT count(*) AS "rows", count(*) FILTER ({anynull}) AS rows_with_missing,
      {', '.join(f'count(*) FILTER ({c} IS NULL) AS {c}_missing' for c in
                 ['brand', 'model', 'sales_volume', 'sales_price', 'energy_type'])} FROM num"""
    o["missing_counts_by_model"] = o["missing_counts"].replace("SELECT count(*) AS \"rows\"",
                                                             "SELECT model, count(*) AS \"rows\"") + " GROUP BY model"
    o["custom_fill"] = f"""WITH {NUM} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      coalesce(brand, '自定义') AS brand, model, coalesce(sales_volume, 7) AS sales_volume,
      {rnd('coalesce(sales_price, (SELECT median(sales_price) FROM num), 0)', 4)} AS sales_price, energy_type FROM num"""
    o["default_fill"] = f"""WITH {NUM} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      coalesce(brand, '未知品牌') AS brand, model, coalesce(sales_volume, 0) AS sales_volume,
      {rnd('coalesce(sales_price, 0)', 4)} AS sales_price, energy_type FROM num"""
    o["store_form"] = f"""WITH {NUM} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, brand, model,
      CAST(trunc(coalesce(sales_volume, 0)) AS BIGINT) AS sales_volume,
      {rnd('coalesce(sales_price, 0)', 2)} AS sales_price, energy_type FROM num"""
    # ------------------------------------------------------------ cleaning jobs
    o["auto_clean_rows"] = f"WITH {AUTO} SELECT {row(extra=', sale_date')} FROM clean"
    report = f"""(SELECT count(*) FROM coerced) AS original_rows,
      (SELECT count(*) FROM coerced) - (SELECT count(*) FROM num) AS duplicates_removed,
      (SELECT count(*) FILTER (sales_volume IS NULL) FROM num) AS volume_filled,
      (SELECT count(*) FILTER (sales_price IS NULL) FROM num) AS price_filled,
      (SELECT count(*) FILTER (brand IS NULL) FROM num) AS brand_filled,
      (SELECT count(*) FILTER (v_out) FROM repaired) AS volume_outliers,
      (SELECT count(*) FILTER (p_out) FROM repaired) AS price_outliers,
      (SELECT count(*) FROM repaired) - (SELECT count(*) FROM clean) AS invalid_removed,
      (SELECT count(*) FROM clean) AS final_rows"""
    o["auto_clean_report"] = f"WITH {AUTO} SELECT {report}"
    o["auto_clean_totals"] = f"""WITH {AUTO}, t AS (SELECT {report}) SELECT original_rows,
      volume_filled + price_filled + brand_filled AS missing_filled, volume_outliers + price_outliers AS outliers_detected,
      duplicates_removed AS rows_removed, invalid_removed, final_rows FROM t"""
    o["auto_clean_warnings"] = f"""WITH {AUTO}, t AS (SELECT {report}, (SELECT pm FROM stats) AS pm)
      SELECT concat('删除 ', duplicates_removed, ' 行完全重复数据|sales_price 列检测到 ', price_outliers,
        ' 个异常值 (|Z|>3)，已替换为中位数 ', pm, '|删除 ', invalid_removed, ' 行品牌/车型为空的无效数据') AS warnings FROM t"""
    by_model = NUM + f""", med AS (SELECT model, median(sales_volume) mv, median(sales_price) mp FROM num GROUP BY 1),
      mb AS (SELECT model, brand AS mb FROM (SELECT model, brand, row_number() OVER (PARTITION BY model
        ORDER BY count(*) DESC, brand) AS k FROM num WHERE brand IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
      filled AS (SELECT num.* REPLACE (coalesce(brand, mb, '未知') AS brand, coalesce(sales_volume, mv, 0) AS sales_volume,
        coalesce(sales_price, mp, 0) AS sales_price), brand IS NULL AS nb, sales_volume IS NULL AS nv,
        sales_price IS NULL AS np FROM num JOIN med USING (model) LEFT JOIN mb USING (model)),
      st AS (SELECT model, count(*) n, avg(sales_volume) va, stddev_pop(sales_volume) vs, median(sales_volume) vm,
        avg(sales_price) pa, stddev_pop(sales_price) ps, median(sales_price) pm FROM filled GROUP BY 1),
      fl AS (SELECT filled.*, vm, pm, coalesce(n > 3 AND abs(sales_volume - va) / nullif(vs, 0) > 3, false) AS v_out,
        coalesce(n > 3 AND abs(sales_price - pa) / nullif(ps, 0) > 3, false) AS p_out
        FROM filled JOIN st USING (model)),
      ok AS (SELECT *, NOT (brand IN {words(fixed.INVALID_NAMES)} OR model IN {words(fixed.INVALID_NAMES)}) AS good FROM fl)"""
    o["auto_clean_rows_by_model"] = f"""WITH {by_model} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      brand, model, {rnd('CASE WHEN v_out THEN vm ELSE sales_volume END', 4)} AS sales_volume,
      {rnd('CASE WHEN p_out THEN pm ELSE sales_price END', 4)} AS sales_price, {std('energy_type')} AS energy_type,
      {day('sale_date')} AS sale_date FROM ok WHERE good"""
    o["auto_clean_totals_by_model"] = f"""WITH {by_model}, c AS (SELECT model, count(*) AS o FROM coerced GROUP BY 1)
      SELECT model, any_value(o) AS original_rows,
      CAST(sum(CAST(nb AS INT) + CAST(nv AS INT) + CAST(np AS INT)) AS BIGINT) AS missing_filled,
      CAST(sum(CAST(v_out AS INT) + CAST(p_out AS INT)) AS BIGINT) AS outliers_detected,
      any_value(o) - count(*) AS rows_removed, count(*) FILTER (NOT good) AS invalid_removed,
      count(*) FILTER (good) AS final_rows FROM ok JOIN c USING (model) GROUP BY model"""

    def interactive(name: str, base: str, keep: str, brand: str, vol: str, price: str, vrange=None):
        cond = f"sales_volume < {vrange[0]} OR sales_volume > {vrange[1]}" if vrange else \
            "coalesce(n > 3 AND abs(sales_volume - va) / nullif(vs, 0) > 3, false)"
        block = f"""{base}, kept AS (SELECT * FROM num WHERE {keep}), filled AS (
          SELECT * REPLACE ({brand} AS brand, {vol} AS sales_volume, {price} AS sales_price) FROM kept),
          st AS (SELECT count(*) n, avg(sales_volume) va, stddev_pop(sales_volume) vs, median(sales_volume) vm,
            avg(sales_price) pa, stddev_pop(sales_price) ps, median(sales_price) pm FROM filled),
          fl AS (SELECT filled.*, vm, pm, {cond} AS v_out,
            coalesce(n > 3 AND abs(sales_price - pa) / nullif(ps, 0) > 3, false) AS p_out FROM filled, st)"""
        o[f"interactive_clean_{name}"] = f"""WITH {block} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
          brand, model, {rnd('CASE WHEN v_out THEN vm ELSE sales_volume END', 4)} AS sales_volume,
          {rnd('CASE WHEN p_out THEN pm ELSE sales_price END', 4)} AS sales_price, {std('energy_type')} AS energy_type,
          {day('sale_date')} AS sale_date FROM fl"""
        filled = "CAST(0 AS BIGINT)" if name == "drop" else \
            "(SELECT count(*) FILTER (brand IS NULL) + count(*) FILTER (sales_volume IS NULL)" \
            " + count(*) FILTER (sales_price IS NULL) FROM num)"
        o[f"interactive_totals_{name}"] = f"""WITH {block} SELECT (SELECT count(*) FROM coerced) AS original_rows,
          {filled} AS missing_filled, count(*) FILTER (v_out) + count(*) FILTER (p_out) AS outliers_detected,
          (SELECT count(*) FROM coerced) - (SELECT count(*) FROM num) AS rows_removed, count(*) AS final_rows FROM fl"""

    interactive("default", NUM, "true", "coalesce(brand, '未知品牌')", "coalesce(sales_volume, 0)",
                "coalesce(sales_price, 0)")
    interactive("custom", NUM, "true", f"coalesce(brand, {mode('brand')})", "coalesce(sales_volume, 9)",
                "coalesce(sales_price, (SELECT median(sales_price) FROM num))", (3, 45))
    interactive("drop", NUM, f"NOT ({anynull})", "brand", "sales_volume", "sales_price")

    # ------------------------------------------------------------ filters and projections
    v = "user_id, upload_id, brand, model, sales_volume, sales_price, energy_type"
    o["tenant_rows"] = f"WITH {VEHICLES} SELECT {v} FROM vehicles WHERE user_id = 7"
    o["category_filter"] = f"WITH {VEHICLES} SELECT {v} FROM vehicles WHERE energy_type = '电车'"
    o["item_filter"] = f"""WITH {VEHICLES} SELECT {v} FROM vehicles
      WHERE concat(brand, ' ', model) IN ('Brand#1 small ring', 'Brand#2 red widget', 'Brand#3 blue bolt')"""
    o["item_filter_by_table"] = f"""WITH {VEHICLES} SELECT {v} FROM vehicles
      WHERE (brand, model) IN (SELECT p_brand, p_name FROM part WHERE p_size >= 45)"""
    o["valid_rows"] = f"WITH {NUM} SELECT {row()} FROM num WHERE {VALID}"
    o["resolve_user"] = f"WITH {USERS} SELECT user_id, username FROM users WHERE user_id = 12"
    o["resolve_user_by_name"] = f"WITH {USERS} SELECT user_id, username FROM users WHERE username = 'Customer#000000033'"
    o["owned_upload"] = f"WITH {UPLOADS} SELECT * FROM uploads WHERE upload_id = 1 AND user_id = (SELECT o_custkey FROM orders WHERE o_orderkey = 1)"
    o["sales_chart"] = f"""WITH {VEHICLES} SELECT concat(brand, ' ', model) AS name, sales_volume AS volume,
      sales_price AS price, CASE WHEN length(concat(brand, ' ', model)) > 10
        THEN concat(substring(concat(brand, ' ', model), 1, 9), '...') ELSE concat(brand, ' ', model) END AS label
      FROM vehicles"""
    o["computed_revenue"] = f"""WITH {VEHICLES} SELECT upload_id, brand, model,
      {rnd('sales_volume * sales_price', 4)} AS revenue FROM vehicles"""
    o["detail_columns"] = f"WITH {VEHICLES} SELECT upload_id, brand, model, sales_volume, sales_price, energy_type FROM vehicles"
    o["scatter"] = f"""WITH {NUM} SELECT l_orderkey, {rnd('coalesce(sales_price, 0)', 4)} AS price,
      CAST(trunc(coalesce(sales_volume, 0)) AS BIGINT) AS volume FROM num"""
    o["scatter_rounded"] = f"""WITH {VEHICLES} SELECT user_id, {rnd('sales_price', 1)} AS price, sales_volume AS sales,
      energy_type AS energy FROM vehicles WHERE {VALID}"""
    o["records_view"] = f"""WITH {AUTO} SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, brand, model,
      strftime(sale_date, '%Y-%m-%d') AS sale_date, energy_type FROM clean"""
    # ------------------------------------------------------------ joins
    o["active_uploads"] = f"""WITH {UPLOADS}, {USERS} SELECT u.user_id, username, active_upload_id, filename, record_count
      FROM users u LEFT JOIN uploads p ON u.active_upload_id = p.upload_id"""
    o["all_uploads"] = f"""WITH {UPLOADS}, {USERS} SELECT p.*, username FROM uploads p JOIN users u USING (user_id)"""
    o["upload_list"] = f"""WITH {TENANTS} SELECT p.*, username,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = p.upload_id) AS archived_count,
      p.upload_id IS NOT DISTINCT FROM u.active_upload_id AS is_active FROM uploads p JOIN users u USING (user_id)"""
    o["user_totals"] = f"""WITH {TENANTS} SELECT user_id, username, created_at,
      (SELECT count(*) FROM vehicles v WHERE v.user_id = u.user_id) AS vehicle_count,
      (SELECT count(*) FROM uploads p WHERE p.user_id = u.user_id) AS upload_count FROM users u"""
    o["user_statistics"] = f"""WITH {TENANTS}, a AS (SELECT user_id, count(*) AS v, count(DISTINCT brand) AS b
      FROM vehicles GROUP BY 1), c AS (SELECT user_id, count(*) AS n FROM uploads GROUP BY 1)
      SELECT u.user_id, username, coalesce(v, 0) AS vehicle_count, coalesce(b, 0) AS brand_count,
      coalesce(n, 0) AS upload_count FROM users u LEFT JOIN a USING (user_id) LEFT JOIN c USING (user_id)"""
    o["current_rows"] = f"""WITH {TENANTS} SELECT u.user_id, upload_id, brand, model, sales_volume, sales_price, energy_type
      FROM users u JOIN vehicles v ON v.upload_id = u.active_upload_id"""
    o["ownership_semi_join"] = f"""WITH {UPLOADS}, {USERS} SELECT active_upload_id AS upload_id, user_id FROM users
      WHERE active_upload_id IS NOT NULL AND EXISTS (SELECT 1 FROM uploads p
        WHERE p.upload_id = active_upload_id AND p.user_id = users.user_id)"""
    o["delete_anti_join"] = f"""WITH {UPLOADS}, {USERS} SELECT * FROM uploads
      WHERE upload_id NOT IN (SELECT active_upload_id FROM users WHERE active_upload_id IS NOT NULL)"""
    o["statistic_broadcast_back"] = f"""WITH {VEHICLES}, s AS (SELECT brand, avg(sales_price) AS a, median(sales_price) AS m
      FROM vehicles GROUP BY 1) SELECT upload_id, brand, {rnd('sales_price - a', 4)} AS off_mean,
      {rnd('sales_price - m', 4)} AS off_median FROM vehicles JOIN s USING (brand)"""
    # ------------------------------------------------------------ aggregates
    o["overview"] = overview("")
    o["overview_by_user"] = overview("user_id")
    o["volume_by_brand"] = f"WITH {VEHICLES} SELECT brand, CAST(sum(sales_volume) AS BIGINT) AS total_sales FROM vehicles GROUP BY 1"
    o["volume_by_brand_by_user"] = f"""WITH {VEHICLES} SELECT user_id, brand, CAST(sum(sales_volume) AS BIGINT) AS total_sales
      FROM vehicles GROUP BY 1, 2"""
    o["row_and_brand_counts"] = f"""WITH {VEHICLES} SELECT count(*) AS "rows", count(DISTINCT brand) AS dims FROM vehicles"""
    o["average_price"] = f"WITH {VEHICLES} SELECT user_id, {rnd('avg(sales_price)', 2)} AS avg_price FROM vehicles GROUP BY 1"
    o["volume_shares"] = f"WITH {VEHICLES} SELECT {oil} AS oil, {electric} AS electric, {hybrid} AS hybrid FROM vehicles"
    o["volume_shares_by_user"] = f"""WITH {VEHICLES} SELECT user_id, {oil} AS oil, {electric} AS electric, {hybrid} AS hybrid
      FROM vehicles GROUP BY 1"""
    o["rows_by_category"] = f"""WITH {VEHICLES} SELECT energy_type, count(*) AS "rows" FROM vehicles GROUP BY 1"""
    o["price_histogram"] = histogram("")
    o["price_histogram_by_user"] = histogram("user_id")
    segments = f"""WITH {VEHICLES}, bins(bin, label, lo, hi) AS (VALUES (0, '0-10万', 0, 10), (1, '10-15万', 10, 15),
      (2, '15-20万', 15, 20), (3, '20-25万', 20, 25), (4, '25-30万', 25, 30), (5, '30-50万', 30, 50), (6, '50万以上', 50, NULL))
      SELECT CAST(bin AS BIGINT) AS bin, label, count(*) AS "rows", {whole('avg(sales_volume)')} AS avg_sales,
      {rnd('avg(PRICE)', 1)} AS avg_price FROM vehicles JOIN bins ON PRICE >= lo AND (hi IS NULL OR PRICE < hi)
      GROUP BY bin, label"""
    o["price_segments"] = segments.replace("PRICE", "sales_price")
    o["price_segments_wide"] = segments.replace("PRICE", "(sales_price * 32)")
    o["overview_with_gaps"] = f"""WITH {VEHICLES}, named AS (
        SELECT user_id, concat(brand, ' ', model) AS name, v, v * sales_price AS r,
          row_number() OVER (PARTITION BY user_id ORDER BY v DESC NULLS LAST, brand, model) AS a,
          row_number() OVER (PARTITION BY user_id ORDER BY v * sales_price DESC NULLS LAST, brand, model) AS b
        FROM (SELECT *, CASE WHEN upload_id % 4 <> 0 THEN sales_volume END AS v FROM vehicles))
      SELECT x.user_id, CASE WHEN x.v IS NULL THEN '-' ELSE x.name END AS top_volume_name, coalesce(x.v, 0) AS top_volume,
        CASE WHEN y.r IS NULL THEN '-' ELSE y.name END AS top_revenue_name, coalesce({rnd('y.r', 2)}, 0) AS top_revenue
      FROM named x JOIN named y ON x.user_id = y.user_id AND x.a = 1 AND y.b = 1"""
    gappy = f"""WITH {VEHICLES}, g AS (SELECT *, CASE WHEN upload_id % 4 <> 0 THEN sales_volume END AS v FROM vehicles), p AS (
        SELECT user_id, count(*) AS n, count(*) FILTER (v > 0 AND sales_price > 0) AS valid, count(DISTINCT (v, sales_price)) AS pairs,
          avg(v) AS mv, min(v) AS v0, max(v) AS v1, avg(sales_price) AS mp, min(sales_price) AS p0, max(sales_price) AS p1
        FROM g WHERE v IS NOT NULL AND sales_price IS NOT NULL GROUP BY 1), s AS (
        SELECT *, CASE WHEN valid >= 3 THEN 'ok' ELSE '有效数据不足（需 ≥3 条，当前 ' || valid || ' 条）' END AS status FROM p)"""
    o["kmeans_by_user"] = f"""{gappy} SELECT user_id, n AS "rows", valid AS valid_rows, status,
        CASE WHEN valid >= 3 THEN least(3, pairs) ELSE 0 END AS clusters, CASE WHEN valid >= 3 THEN n ELSE 0 END AS assigned,
        CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS off_centre, false AS cost_differs FROM s"""
    o["kmeans_summary_by_user"] = f"""{gappy} SELECT user_id, n AS "rows", {rnd('mp', 1)} AS avg_price, {rnd('mv', 1)} AS avg_sales,
        {rnd('p0', 1)} AS price_min, {rnd('p1', 1)} AS price_max, {whole('v0')} AS sales_min, {whole('v1')} AS sales_max,
        valid AS valid_rows, status, CAST(3 AS BIGINT) AS k FROM s"""
    o["summary_kept_up"] = f"""WITH {FACTS}, sent AS (
        SELECT l_orderkey % 5 AS user_id, brand, model, CAST(sales_volume AS BIGINT) * CASE WHEN l_orderkey % 5 < 3 THEN 2 ELSE 1 END AS v, sales_price
        FROM facts WHERE l_orderkey % 5 > 0), best AS (
        SELECT user_id, v, brand || ' ' || model AS name, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, brand, model) AS a FROM sent), items AS (
        SELECT user_id, model, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, model) AS a FROM sent GROUP BY 1, 2), dims AS (
        SELECT user_id, brand, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, brand) AS a FROM sent GROUP BY 1, 2), told AS (
        SELECT user_id, count(*) AS record_count, count(DISTINCT brand) AS brand_count, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands,
          {rnd('avg(sales_price)', 2)} AS avg_price, count(*) AS total_rows FROM sent GROUP BY 1)
      SELECT told.*, best.v AS top_volume, best.name AS top_volume_name, items.model AS top_item_by_rows, dims.brand AS top_dim_by_rows
      FROM told JOIN best USING (user_id) JOIN items USING (user_id) JOIN dims USING (user_id) WHERE best.a = 1 AND items.a = 1 AND dims.a = 1"""
    o["upload_quarantine"] = f"""WITH {FACTS}, sent AS (
        SELECT l_orderkey % 5 AS user_id, sales_volume, l_orderkey, l_orderkey % 10 = 7 AS bad, 'more cells than columns' AS reason FROM facts
        UNION ALL SELECT l_orderkey % 5 + 10, sales_volume, l_orderkey, l_orderkey % 10 = 3, 'not a JSON object' FROM facts), told AS (
        SELECT user_id, 'stored' AS status, count(*) FILTER (NOT bad) AS stored_rows, count(*) FILTER (bad) AS rejected_rows,
          '上传成功！共导入 ' || count(*) FILTER (NOT bad) || ' 条数据' AS message, max(reason) FILTER (bad) AS reason,
          CAST(sum(l_orderkey) FILTER (bad) AS BIGINT) AS reject_keys, nullif(count(*) FILTER (bad), 0) AS placed,
          CAST(sum(sales_volume) FILTER (NOT bad) AS BIGINT) AS volume FROM sent GROUP BY 1)
      SELECT * FROM told UNION ALL SELECT 20, 'rejected', 0, 0, 'columns', NULL, NULL, NULL, NULL
      UNION ALL SELECT 21, 'rejected', 0, 0, '文件内容为空', NULL, NULL, NULL, NULL"""
    o["segment_bars"] = f"""WITH s AS ({o['price_segments']}) SELECT bin, label, avg_sales,
      CAST(round(avg_sales * 100.0 / (SELECT max(avg_sales) FROM s)) AS BIGINT) AS pct FROM s"""
    o["brand_measures"] = f"""WITH {VEHICLES} SELECT brand, CAST(sum(sales_volume) AS BIGINT) AS total_sales,
      {rnd('avg(sales_price)', 4)} AS avg_price, count(model) AS item_rows,
      {rnd('sum(sales_volume) / avg(sales_price)', 4)} AS value_index FROM vehicles GROUP BY 1"""
    o["brand_category_pivot"] = f"""WITH {VEHICLES} SELECT brand,
      {', '.join(f"CAST(coalesce(sum(sales_volume) FILTER ({stratum(c)}), 0) AS BIGINT) AS "
                 f'"{c}"' for c in fixed.CATEGORY_SPELLINGS)} FROM vehicles GROUP BY 1"""
    top15 = f"""{VEHICLES}, top AS (SELECT brand, model, sales_volume, sales_price, energy_type FROM vehicles
      ORDER BY sales_volume DESC, brand, model, sales_price, energy_type LIMIT 15)"""
    o["chart_info"] = f"""WITH {top15} SELECT true AS success, count(*) AS data_count,
      CAST(sum(sales_volume) AS BIGINT) AS total_sales, {rnd('avg(sales_price)', 2)} AS avg_price FROM top"""
    o["brand_share"] = f"""WITH {VEHICLES}, s AS (SELECT brand, CAST(sum(sales_volume) AS BIGINT) AS total_sales
      FROM vehicles GROUP BY 1) SELECT brand, total_sales,
      {rnd('total_sales * 100.0 / (SELECT sum(total_sales) FROM s)', 2)} AS pct FROM s"""
    o["histogram_share"] = f"""WITH h AS ({histogram('')}) SELECT bin, label, "rows",
      {rnd('"rows" * 100.0 / (SELECT sum("rows") FROM h)', 1)} AS pct FROM h"""
    o["collapse_small_slices"] = f"""WITH {VEHICLES}, s AS (SELECT model, sum(sales_volume) AS v FROM vehicles GROUP BY 1),
      t AS (SELECT model, v, v >= 0.02 * (SELECT sum(v) FROM s) AS big FROM s)
      SELECT CASE WHEN big THEN model ELSE '其他' END AS slice, CAST(sum(v) AS BIGINT) AS size, NOT big AS is_other
      FROM t GROUP BY 1, 3"""
    o["measure_ranges"] = f"""WITH {VEHICLES} SELECT energy_type, count(*) AS "rows", {rnd('avg(sales_price)', 1)} AS avg_price,
      {rnd('avg(sales_volume)', 1)} AS avg_sales, {rnd('min(sales_price)', 1)} AS price_min,
      {rnd('max(sales_price)', 1)} AS price_max, min(sales_volume) AS sales_min, max(sales_volume) AS sales_max
      FROM vehicles GROUP BY 1"""
    o["summary_snapshot"] = f"""WITH {VEHICLES} SELECT user_id, count(*) AS record_count, count(DISTINCT brand) AS brand_count,
      string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands,
      concat(count(*) FILTER ({stratum('油车')}), '/', count(*) FILTER ({stratum('混动')}), '/',
             count(*) FILTER ({stratum('电车')})) AS energy_distribution,
      {rnd('avg(sales_price)', 2)} AS avg_price FROM vehicles GROUP BY 1"""
    # ------------------------------------------------------------ ranking
    order = "sales_volume DESC, brand, model, sales_price, energy_type"
    o["top_rows_per_user"] = f"""WITH {VEHICLES} SELECT * FROM (SELECT user_id, brand, model, sales_volume, sales_price,
      energy_type, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rank FROM vehicles) WHERE rank <= 10"""
    o["top_rows_per_upload"] = f"""WITH {TENANTS} SELECT t.*, username, filename FROM (
      SELECT upload_id, brand, model, sales_volume, sales_price, energy_type,
        row_number() OVER (PARTITION BY upload_id ORDER BY {order}) AS rank FROM vehicles) t
      JOIN uploads USING (upload_id) JOIN users USING (user_id) WHERE rank <= 3"""
    o["top_rows_volume"] = f"WITH {top15} SELECT * FROM top"
    o["top_rows_price_ascending"] = f"""WITH {VEHICLES} SELECT brand, model, sales_volume, sales_price, energy_type
      FROM vehicles ORDER BY sales_price DESC, brand, model, sales_volume, energy_type LIMIT 20"""
    o["largest_rows"] = f"""WITH {VEHICLES} SELECT brand, model, sales_volume, sales_price FROM vehicles
      ORDER BY sales_volume DESC, brand, model, sales_price LIMIT 10"""
    o["largest_rows_by_user"] = f"""WITH {VEHICLES} SELECT user_id, brand, model, sales_volume, sales_price FROM vehicles
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sales_volume DESC, brand, model, sales_price) <= 3"""
    o["chart_info_by_user"] = f"""WITH {VEHICLES}, top AS (SELECT * FROM vehicles QUALIFY row_number() OVER (
        PARTITION BY user_id ORDER BY sales_volume DESC, brand, model, sales_price, energy_type) <= 15)
      SELECT user_id, true AS success, count(*) AS data_count, CAST(sum(sales_volume) AS BIGINT) AS total_sales,
      {rnd('avg(sales_price)', 2)} AS avg_price FROM top GROUP BY 1"""
    o["radar_brands_by_user"] = f"""WITH {VEHICLES}, s AS (SELECT user_id, brand, CAST(sum(sales_volume) AS BIGINT) AS total_sales
        FROM vehicles GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total_sales DESC, brand) <= 6),
      w AS (SELECT *, min(total_sales) OVER u AS lo, max(total_sales) OVER u AS hi, count(*) OVER u AS n FROM s
        WINDOW u AS (PARTITION BY user_id))
      SELECT user_id, brand, substr(brand, 1, 8) AS label, total_sales, n >= 3 AS enough,
      CASE WHEN lo = hi THEN 50.0 ELSE {rnd('(total_sales - lo) / (hi - lo) * 80.0 + 20.0', 4)} END AS total_sales_scaled FROM w"""
    o["top_brands"] = f"""WITH {VEHICLES}, s AS (SELECT brand, CAST(sum(sales_volume) AS BIGINT) AS total_sales FROM vehicles
      GROUP BY 1) SELECT *, row_number() OVER (ORDER BY total_sales DESC, brand) AS rank FROM s QUALIFY rank <= 7"""
    o["top_brands_by_user"] = f"""WITH {VEHICLES}, s AS (SELECT user_id, brand, CAST(sum(sales_volume) AS BIGINT) AS total_sales
      FROM vehicles GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total_sales DESC, brand)
      AS rank FROM s QUALIFY rank <= 7"""
    o["radar_brands"] = f"""WITH {VEHICLES}, s AS (SELECT brand, CAST(sum(sales_volume) AS BIGINT) AS total_sales,
      avg(sales_price) AS avg_price, count(*) AS item_rows, sum(sales_volume) / avg(sales_price) AS value_index
      FROM vehicles GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
      SELECT brand, total_sales, {rnd('avg_price', 4)} AS avg_price, item_rows, {rnd('value_index', 4)} AS value_index,
      true AS enough, {', '.join(
          rnd(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 80.0 + 20.0', 4) + f' AS {c}_scaled'
          for c in ['total_sales', 'avg_price', 'item_rows', 'value_index'])} FROM s"""
    o["stack_offsets"] = f"""WITH {VEHICLES}, s AS (SELECT brand, energy_type, CAST(sum(sales_volume) AS BIGINT) AS volume
      FROM vehicles GROUP BY 1, 2) SELECT *, CAST(coalesce(sum(volume) OVER (PARTITION BY brand ORDER BY energy_type
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom FROM s"""
    o["average_ranks"] = f"""WITH {VEHICLES}, {xy()} SELECT x, y, count(*) AS copies,
      any_value(rx) AS rank_x, any_value(ry) AS rank_y FROM (SELECT x, y,
      rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
      rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM xy) GROUP BY 1, 2"""
    o["contiguous_folds"] = f"""WITH {FOLDED} SELECT fold, count(*) AS "rows", sum(y) AS volume FROM folded GROUP BY 1"""
    o["contiguous_folds_by_user"] = f"""WITH {VEHICLES}, {_FEATURES}, f AS (SELECT *,
      ntile(5) OVER (PARTITION BY user_id ORDER BY brand, model, x0, y, x1, x2) - 1 AS fold FROM feats
      QUALIFY count(*) OVER (PARTITION BY user_id) >= 5)
      SELECT user_id, fold, count(*) AS "rows", sum(y) AS volume FROM f GROUP BY 1, 2"""
    o["sorted_rows"] = f"WITH {VEHICLES} SELECT brand, model, sales_volume, sales_price FROM vehicles"
    o["newest_uploads"] = f"WITH {UPLOADS} SELECT * FROM uploads ORDER BY created_at DESC, upload_id DESC LIMIT 25"
    # ------------------------------------------------------------ statistics
    fit = "corr(x, y) AS r, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2"
    o["linear_fit"] = f"""WITH {VEHICLES}, {xy()}, f AS (SELECT count(*) AS n, {fit} FROM xy)
      SELECT n, {', '.join(rnd(c, 6) + f' AS {c}' for c in ['r', 'slope', 'intercept', 'r2'])} FROM f"""
    o["linear_fit_by_brand"] = f"""WITH {VEHICLES}, {xy('brand')}, f AS (SELECT brand, count(*) AS n, {fit} FROM xy GROUP BY 1)
      SELECT brand, n, {', '.join(rnd(c, 6) + f' AS {c}' for c in ['r', 'slope', 'intercept', 'r2'])} FROM f"""
    o["spearman"] = f"WITH {VEHICLES}, {xy()}, {ranks('')} SELECT count(*) AS n, {rnd('corr(rx, ry)', 6)} AS rho FROM ranked"
    o["spearman_by_brand"] = f"""WITH {VEHICLES}, {xy('brand')}, {ranks('brand')}
      SELECT brand, count(*) AS n, {rnd('corr(rx, ry)', 6)} AS rho FROM ranked GROUP BY 1"""
    o["correlation_wording"] = f"""WITH {VEHICLES}, {xy('user_id')}, f AS (SELECT user_id, count(*) AS n, corr(x, y) AS r
      FROM xy GROUP BY 1 HAVING count(*) >= 5), g AS (SELECT *, CASE WHEN r > 0 THEN '正相关' ELSE '负相关' END AS s FROM f)
      SELECT user_id, n AS data_points, {rnd('r', 4)} AS pearson_r, {STRENGTH} AS interpretation FROM g"""
    o["stratified_correlation"] = f"""WITH {VEHICLES}, f AS (SELECT user_id, energy_type, count(*) AS n,
      corr(sales_price, sales_volume) AS r, avg(sales_price) AS mx, avg(sales_volume) AS my FROM vehicles
      WHERE {VALID} GROUP BY 1, 2)
      SELECT user_id, energy_type, n, CASE WHEN n >= 3 THEN {rnd('r', 4)} END AS r,
      CASE WHEN n >= 3 THEN {rnd('mx', 1)} END AS avg_price, CASE WHEN n >= 3 THEN {rnd('my', 1)} END AS avg_sales,
      CASE WHEN n < 3 THEN '样本不足' END AS note FROM f"""
    o["stratified_p_by_user"] = f"""WITH {VEHICLES}, f AS (SELECT user_id, energy_type, count(*) AS n,
      corr(sales_price, sales_volume) AS r FROM vehicles WHERE {VALID} GROUP BY 1, 2), {p_values('f', 'user_id, energy_type', 2000)}
      SELECT user_id, energy_type, n, CASE WHEN n >= 3 THEN {P_TEXT} END AS p, coalesce(n >= 3 AND p < 0.05, false) AS significant FROM f_p"""
    o["stratified_significance"] = f"""WITH {VEHICLES}, f AS (SELECT energy_type, count(*) AS n,
      corr(sales_price, sales_volume) AS r, avg(sales_price) AS mx, avg(sales_volume) AS my FROM vehicles
      WHERE {VALID} GROUP BY 1), {p_values('f', 'energy_type', 40000)}
      SELECT energy_type, n, CASE WHEN n >= 3 THEN {rnd('r', 4)} END AS r, CASE WHEN n >= 3 THEN {P_TEXT} END AS p,
      coalesce(n >= 3 AND p < 0.05, false) AS significant, CASE WHEN n >= 3 THEN {rnd('mx', 1)} END AS avg_price,
      CASE WHEN n >= 3 THEN {rnd('my', 1)} END AS avg_sales, CASE WHEN n < 3 THEN '样本不足' END AS note FROM f_p"""
    for name, key in (("correlation_overall", ""), ("correlation_overall_by_brand", "brand")):
        comma, group = (f"{key}, ", "GROUP BY 1") if key else ("", "")
        o[name] = f"""WITH {VEHICLES}, {xy(key)}, {ranks(key)}, f AS (SELECT {comma}count(*) AS n, corr(x, y) AS r, regr_r2(y, x) AS r2,
            regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM xy {group}), h AS (SELECT {comma}count(*) AS n, corr(rx, ry) AS r FROM ranked {group}),
          {p_values('f', key or "'all'", 40000)}, {p_values('h', key or "'all'", 40000)}
          SELECT {f'f_p.k AS {key}, ' if key else ''}true AS success, NULL::VARCHAR AS error, f_p.n AS data_points, {rnd('f_p.r', 4)} AS pearson_r,
            {P_TEXT.replace('(p', '(f_p.p').replace('WHEN p', 'WHEN f_p.p')} AS pearson_p, {rnd('h_p.r', 4)} AS spearman_rho,
            {P_TEXT.replace('(p', '(h_p.p').replace('WHEN p', 'WHEN h_p.p')} AS spearman_p,
            (SELECT {STRENGTH} FROM (SELECT f_p.r AS r, CASE WHEN f_p.r > 0 THEN '正相关' ELSE '负相关' END AS s)) AS interpretation,
            {rnd('r2', 4)} AS r_squared, printf('销量 ≈ %.0f + %.1f × 价格', a, b) AS equation
          FROM f_p JOIN h_p USING (k)"""
    counter = f"""{VEHICLES}, f AS (SELECT {{k}} regr_slope(sales_volume, sales_price) AS b,
      regr_intercept(sales_volume, sales_price) AS a, count(*) AS n FROM vehicles WHERE {VALID} {{g}}),
      s AS (SELECT {{k2}} brand, model, sales_price AS x, sales_volume AS y, a + b * sales_price AS e,
        {rnd('abs(sales_volume - (a + b * sales_price))', 6)} AS residual FROM vehicles {{j}} WHERE {VALID} AND n >= 5)"""
    cols = f"""concat(brand, ' ', model) AS model, {rnd('x', 1)} AS price, CAST(y AS BIGINT) AS actual_sales,
      {whole('e')} AS expected_sales, {rnd('residual', 4)} AS residual, CASE WHEN y > e THEN '高于' ELSE '低于' END AS direction"""
    o["counterexamples"] = f"""WITH {counter.format(k='', g='', k2='', j='CROSS JOIN f')}
      SELECT {cols} FROM (SELECT * FROM s ORDER BY residual DESC, brand, model, x, y LIMIT 4)"""
    o["counterexamples_by_brand"] = f"""WITH {counter.format(k='brand,', g='GROUP BY 1', k2='', j='JOIN f USING (brand)')}
      SELECT brand, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY brand
        ORDER BY residual DESC, brand, model, x, y) AS k FROM s) WHERE k <= 4"""
    o["regression_features"] = f"""WITH {VEHICLES}, {_FEATURES} SELECT brand, model, x0 AS price, CAST(x1 AS BIGINT) AS is_electric,
      CAST(x2 AS BIGINT) AS is_hybrid, y FROM feats"""
    o["feature_scaling"] = f"""WITH {VEHICLES}, {_FEATURES} SELECT count(*) AS n,
      {', '.join(f"{rnd(f'avg({x})', 6)} AS {c}_mean, {rnd(f'stddev_pop({x})', 6)} AS {c}_std"
                 for x, c in [('x0', 'price'), ('x1', 'is_electric'), ('x2', 'is_hybrid')])} FROM feats"""
    o["regression_fit"] = f"""WITH {MODEL} SELECT n, {rnd('my', 4)} AS intercept, {rnd('w0 * d0', 4)} AS coef_price,
      {rnd('w1 * d1', 4)} AS coef_is_electric, {rnd('w2 * d2', 4)} AS coef_is_hybrid, {rnd('w', 4)} AS raw_intercept,
      {rnd('w0', 4)} AS raw_price, {rnd('w1', 4)} AS raw_is_electric, {rnd('w2', 4)} AS raw_is_hybrid FROM model"""
    o["regression_fit_by_brand"] = f"""WITH {VEHICLES.replace('SELECT o_custkey AS user_id', 'SELECT o_custkey AS user_id')},
      {_FEATURES}, mom AS ({_moments('feats', 'brand')}), sol AS ({_solved('mom')})
      SELECT brand, n, {rnd('my', 4)} AS intercept, {rnd('w0 * d0', 4)} AS coef_price, {rnd('w1 * d1', 4)} AS coef_is_electric,
      {rnd('w2 * d2', 4)} AS coef_is_hybrid FROM sol"""
    o["regression_metrics"] = f"""WITH {MODEL} SELECT {rnd('r2', 4)} AS r2, {rnd('rmse', 1)} AS rmse, {rnd('mae', 1)} AS mae,
      n AS data_points, CASE WHEN r2 >= 0 THEN 'predictive' ELSE 'exploratory' END AS mode FROM metric, model"""
    o["cross_validation"] = f"""WITH {FOLDED}, mom AS (SELECT g.fold, m.* FROM (VALUES (0),(1),(2),(3),(4)) g(fold),
      LATERAL ({_moments('folded t WHERE t.fold <> g.fold')}) m), sol AS ({_solved('mom')}),
      sc AS (SELECT t.fold, t.y, s.my + w0 * (x0 - m0) + w1 * (x1 - m1) + w2 * (x2 - m2) AS yhat
        FROM folded t JOIN sol s ON s.fold = t.fold),
      r AS (SELECT fold, 1 - sum((y - yhat) ** 2) / (count(*) * var_pop(y)) AS r2 FROM sc GROUP BY 1)
      SELECT count(*) AS folds, {rnd('avg(r2)', 4)} AS cv_r2_mean FROM r"""
    seasons = ", ".join(f"({m}, {f})" for m, f in fixed.SEASONAL_FACTORS.items())
    o["prediction"] = f"""WITH {MODEL}, given AS (SELECT p_partkey, p_retailprice / 50 AS price,
      {_KIND} AS energy_type, p_size % 13 AS month FROM part), season(m, fac) AS (VALUES {seasons}),
      q AS (SELECT g.*, greatest(0, w + w0 * price + w1 * CAST(contains(energy_type, '电') AS INT)
        + w2 * CAST(contains(energy_type, '混') OR contains(energy_type, 'DM') OR contains(energy_type, 'PHEV') AS INT))
        AS monthly, round(CAST(rmse AS DECIMAL(38,8)), 1) AS e, coalesce(fac, 1.005) AS factor FROM given g CROSS JOIN model
        CROSS JOIN metric LEFT JOIN season ON month = m)
      SELECT p_partkey, {whole('monthly')} AS monthly_sales, {whole('monthly * 12 * factor')} AS annual_sales,
      CASE WHEN month <> 0 THEN 'seasonal' ELSE 'naive' END AS annual_method,
      {whole('greatest(0, monthly - 1.96 * CAST(e AS DOUBLE))')} AS interval_low,
      {whole('monthly + 1.96 * CAST(e AS DOUBLE)')} AS interval_high FROM q"""
    o["seasonal_annualisation"] = f"""WITH {VEHICLES}, season(m, fac) AS (VALUES {seasons}),
      s AS (SELECT month(sale_date) AS m, sum(sales_volume) AS v FROM vehicles GROUP BY 1)
      SELECT CAST(m AS BIGINT) AS month, CAST(v AS BIGINT) AS volume, {whole("v * 12.0 * fac")} AS annual_sales,
      'seasonal' AS annual_method, CAST(fac AS DOUBLE) AS factor FROM s JOIN season USING (m)"""
    o["nearest_centroid"] = f"""WITH {CLUSTERED} SELECT upload_id, brand, model, sales_price, sales_volume, cluster FROM assigned"""
    prof = f"""SELECT cluster, row_number() OVER (ORDER BY avg(sales_volume) DESC, cluster) AS rank, count(*) AS "rows",
      avg(sales_price) AS mx, avg(sales_volume) AS my, min(sales_price) AS x0, max(sales_price) AS x1,
      min(sales_volume) AS y0, max(sales_volume) AS y1, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands
      FROM assigned GROUP BY 1"""
    o["cluster_profile"] = f"""WITH {CLUSTERED}, p AS ({prof}) SELECT cluster, rank,
      concat('簇', rank, '·', CASE WHEN rank = 1 THEN '高销量主力' WHEN mx > 25 THEN '高端车型' WHEN mx < 12 THEN '经济车型'
        ELSE '中端均衡' END) AS label, "rows", {rnd('mx', 1)} AS avg_price, {rnd('my', 1)} AS avg_sales,
      {rnd('x0', 1)} AS price_min, {rnd('x1', 1)} AS price_max, y0 AS sales_min, y1 AS sales_max, brands FROM p"""
    o["cluster_categories"] = f"""WITH {CLUSTERED} SELECT cluster, energy_type, count(*) AS "rows" FROM assigned GROUP BY 1, 2"""
    o["cluster_extremes"] = f"""WITH {CLUSTERED}, m AS (SELECT cluster, avg(sales_price) AS mx, avg(sales_volume) AS my
      FROM assigned GROUP BY 1), d AS (SELECT a.*, {rnd('sqrt((sales_price - mx) ** 2 + (sales_volume - my) ** 2)', 6)} AS dist
      FROM assigned a JOIN m USING (cluster)), k AS (SELECT *, row_number() OVER (PARTITION BY cluster
      ORDER BY dist DESC, brand, model, sales_price, sales_volume) AS k FROM d)
      SELECT concat(brand, ' ', model) AS name, sales_price AS price, CAST(sales_volume AS DOUBLE) AS sales, cluster,
      {rnd('dist', 4)} AS distance, concat('距簇', cluster, '质心最远，可能属于其他细分市场') AS reason FROM k WHERE k = 1"""
    # ------------------------------------------------------------ charts and report
    label = "concat(substring(brand, 1, 4), substring(model, 1, 6)) AS label"
    o["chart_bar"] = f"WITH {top15} SELECT *, {label} FROM top"
    o["chart_filtered_line"] = f"""WITH {VEHICLES} SELECT brand, model, sales_volume, sales_price, energy_type, {label}
      FROM vehicles WHERE energy_type = '混动' ORDER BY sales_price DESC, brand, model, sales_volume, energy_type LIMIT 12"""
    o["chart_pie"] = f"""WITH {VEHICLES}, top AS (SELECT * FROM vehicles ORDER BY {order} LIMIT 60),
      t AS (SELECT {label}, sales_volume AS v, sales_volume >= 0.02 * (SELECT sum(sales_volume) FROM top) AS big FROM top)
      SELECT label AS slice, v AS size, false AS is_other FROM t WHERE big UNION ALL
      SELECT '其他', CAST(sum(v) AS BIGINT), true FROM t WHERE NOT big HAVING sum(v) > 0"""
    o["chart_scatter"] = f"""WITH {top15} SELECT *, {label},
      {rnd('sales_price / (SELECT max(sales_price) FROM top) * 400 + 50', 4)} AS bubble FROM top"""
    o["chart_horizontal_bar"] = o["chart_bar"]
    everything = f"{VEHICLES}, top AS (SELECT * FROM vehicles)"
    o["chart_stacked_bar"] = f"""WITH {everything}, s AS (SELECT brand, energy_type, CAST(sum(sales_volume) AS BIGINT) AS volume
      FROM top GROUP BY 1, 2) SELECT *, CAST(coalesce(sum(volume) OVER (PARTITION BY brand ORDER BY energy_type
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom, substring(brand, 1, 6) AS label FROM s"""
    o["report_leaders_json"] = f"""WITH {VEHICLES}, s AS (SELECT user_id, brand, CAST(sum(sales_volume) AS BIGINT) AS v,
      row_number() OVER (PARTITION BY user_id ORDER BY sum(sales_volume) DESC, brand) AS k FROM vehicles GROUP BY 1, 2)
      SELECT user_id, concat('[', string_agg(concat('{{"brand":"', brand, '","sales":', v, '}}'), ',' ORDER BY k), ']')
      AS brand_sales FROM s WHERE k <= 10 GROUP BY 1"""
    o["narrative_report"] = _report()
    # ------------------------------------------------------------ batches on files
    o["batch_read_back"] = f"""WITH {VEHICLES} SELECT upload_id, brand, model, sales_volume, sales_price, energy_type FROM vehicles"""
    o["batch_log"] = f"""WITH {UPLOADS} SELECT upload_id, user_id, filename,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = upload_id) AS record_count FROM uploads"""
    o["batch_current"] = f"""WITH {TENANTS} SELECT u.user_id, upload_id, brand, model, sales_volume, sales_price, energy_type
      FROM users u JOIN vehicles v ON v.upload_id = u.active_upload_id"""
    o["batch_after_delete"] = f"""WITH {TENANTS} SELECT v.upload_id, count(*) AS "rows" FROM vehicles v
      WHERE v.upload_id NOT IN (SELECT active_upload_id FROM users WHERE active_upload_id IS NOT NULL) GROUP BY 1"""
    o["replace_current_rows"] = f"""WITH {VEHICLES} SELECT user_id % 8 AS slot, brand, model,
      CASE WHEN user_id % 8 = 3 THEN sales_volume * 2 ELSE sales_volume END AS sales_volume, sales_price, energy_type
      FROM vehicles"""
    o["csv_scan"] = f"WITH {RAW} SELECT l_orderkey, l_linenumber, brand, model, sales_volume, sales_price, energy_type, sale_date FROM raw"
    o["csv_scan_mixed_encodings"] = o["csv_scan"]
    o["csv_scan_blank_first_lines"] = o["csv_scan"]
    o["json_scan"] = o["csv_scan"]
    o["reupload_and_delete"] = """SELECT l_orderkey % 5 AS user_id, count(*) AS "rows", CAST(3 * sum(l_quantity) AS BIGINT) AS volume,
      2 AS batches, 2 * count(*) AS archived FROM lineitem GROUP BY 1"""
    o["streaming_mixed_files"] = f"""WITH {FACTS} SELECT l_orderkey % 5 AS user_id, count(*) AS "rows", count(DISTINCT brand) AS brands,
      count(DISTINCT model) AS models, count(DISTINCT {std('energy_type')}) AS energy_types FROM facts GROUP BY 1"""
    o["flagship_brand_ranking"] = f"""WITH {AUTO}, s AS (SELECT brand, {rnd('sum(sales_volume)', 2)} AS total_sales,
      {rnd('avg(sales_price)', 2)} AS avg_price, count(*) AS "rows" FROM clean GROUP BY 1)
      SELECT *, row_number() OVER (ORDER BY total_sales DESC, brand) AS rank FROM s QUALIFY rank <= 7"""
    return o
