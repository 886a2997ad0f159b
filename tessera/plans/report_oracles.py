"""DuckDB SQL of the report plans.

``{bars}``, ``{macro}``, ``{news}`` and table names are inputs; ``PCT(x; p)`` is the linearly
interpolated percentile and ``REPLACE_ALL(x; pattern; by)`` replaces every match.
"""

from __future__ import annotations

import re

from ..sources import panels
from .reports import NEGATIVE, POSITIVE

INPUTS = {"bars": panels.BARS_SQL, "macro": panels.MACRO_SQL, "news": panels.NEWS_SQL}

_LABEL = "CASE WHEN p_pos >= p_neg AND p_pos >= p_neu THEN 'pos' WHEN p_neg >= p_neu THEN 'neg' ELSE 'neu' END"
_RET = "(SELECT asset, date, ln(adj_close) - lag(ln(adj_close)) OVER (PARTITION BY asset ORDER BY date) AS r FROM {bars})"
_CUBE = "(SELECT n_name AS arm, c_mktsegment AS model, year(o_orderdate) AS backend, o_totalprice AS metric FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey)"
_EQ = "(SELECT date, sum(r) OVER (ORDER BY date) AS lv FROM (SELECT date, avg(r) AS r FROM " + _RET + " q WHERE r IS NOT NULL GROUP BY date) q2)"

_SQL: dict[str, str] = {
    "market_return": f"SELECT date, round(avg(r), 8) AS market_ret, count(r) AS n FROM {_RET} q GROUP BY date",
    "trading_calendar": "SELECT date FROM {bars} GROUP BY date HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM {bars})",
    "universe_topk": """SELECT asset, round(mdv, 4) AS median_dollar_volume FROM (SELECT asset, PCT(close * volume; 0.5) AS mdv, count(DISTINCT date) AS n FROM {bars} GROUP BY asset) q
        WHERE n >= 0.9 * (SELECT max(n) FROM (SELECT count(DISTINCT date) AS n FROM {bars} GROUP BY asset) m) ORDER BY mdv DESC, asset LIMIT 10""",
    "class_mix": f"SELECT group_key, round(avg(CASE WHEN lab = 'pos' THEN 1.0 ELSE 0.0 END), 8) AS share_pos, round(avg(CASE WHEN lab = 'neg' THEN 1.0 ELSE 0.0 END), 8) AS share_neg, round(avg(conf), 8) AS mean_confidence, count(*) AS n FROM (SELECT group_key, {_LABEL} AS lab, greatest(p_pos, p_neg, p_neu) AS conf FROM {{news}}) q GROUP BY group_key",
    "audit_distribution": """SELECT group_key, n, round(m, 6) AS mean, round(sqrt(v), 6) AS sd, CASE WHEN n > 2 AND v > 0 THEN round(m3 / (v * sqrt(v)), 5) END AS skew, CASE WHEN n > 3 AND v > 0 THEN round(m4 / (v * v) - 3, 5) END AS kurtosis
        FROM (SELECT n1.group_key, count(*) AS n, any_value(mu) AS m, avg((raw_score - mu) * (raw_score - mu)) AS v, avg(power(raw_score - mu, 3)) AS m3, avg(power(raw_score - mu, 4)) AS m4
              FROM {news} n1 JOIN (SELECT group_key, avg(raw_score) AS mu FROM {news} GROUP BY group_key) c ON n1.group_key = c.group_key GROUP BY n1.group_key) q""",
    "same_sign_concentration": "SELECT ticker, count(*) AS n, round(avg(CASE WHEN raw_score > 0 THEN 1.0 ELSE 0.0 END), 8) AS share_pos FROM {news} WHERE raw_score <> 0 GROUP BY ticker HAVING avg(CASE WHEN raw_score > 0 THEN 1.0 ELSE 0.0 END) > 0.6 OR avg(CASE WHEN raw_score > 0 THEN 1.0 ELSE 0.0 END) < 0.4",
    "quantile_table": "SELECT group_key, round(PCT(raw_score; 0.1), 6) AS p10, round(PCT(raw_score; 0.5), 6) AS median, round(PCT(raw_score; 0.9), 6) AS p90, round(PCT(raw_score; 0.75) - PCT(raw_score; 0.25), 6) AS iqr, round(avg(CASE WHEN greatest(p_pos, p_neg, p_neu) > 0.9 THEN 1.0 ELSE 0.0 END), 8) AS share_sure FROM {news} GROUP BY group_key",
    "score_histogram": """SELECT b AS bin, count(*) AS n, round(count(*) / (0.025 * any_value(total)), 8) AS density FROM (SELECT least(CAST(floor((raw_score + 1) / 0.025) AS INT), 79) AS b, (SELECT count(*) FROM {news}) AS total FROM {news}) q GROUP BY b""",
    "ecdf": "SELECT x, round(sum(n) OVER (ORDER BY x) / (SELECT count(*) FROM {news}), 8) AS share FROM (SELECT round(raw_score, 2) AS x, count(*) AS n FROM {news} GROUP BY round(raw_score, 2)) q",
    "monthly_sentiment": "SELECT group_key, year(valid_time) AS y, month(valid_time) AS m, round(avg(raw_score), 8) AS mean, round(stddev_samp(raw_score), 6) AS sd FROM {news} GROUP BY group_key, year(valid_time), month(valid_time)",
    "monthly_pivot": "SELECT year(date) AS y, month(date) AS m, " + ", ".join(f"round(avg(CASE WHEN asset = 'Brand#{i}' THEN close END), 4) AS brand_{i}" for i in range(1, 26)) + " FROM {bars} GROUP BY year(date), month(date)",
    "psi": """SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM (SELECT b, sum(CASE WHEN late THEN 1.0 ELSE 0.0 END) / any_value(nl) + 0.000001 AS a, sum(CASE WHEN late THEN 0.0 ELSE 1.0 END) / any_value(ne) + 0.000001 AS e FROM (
          SELECT late, """ + " + ".join(f"CASE WHEN raw_score >= e{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + """ AS b, sum(CASE WHEN late THEN 1 ELSE 0 END) OVER () AS nl, sum(CASE WHEN late THEN 0 ELSE 1 END) OVER () AS ne
          FROM (SELECT raw_score, article_id % 2 = 1 AS late, 1 AS one FROM {news}) s JOIN (SELECT 1 AS one, """ + ", ".join(f"PCT(raw_score; 0.{i}) AS e{i}" for i in range(1, 10)) + """ FROM {news} WHERE article_id % 2 = 0) edges ON s.one = edges.one) q GROUP BY b) z""",
    "spearman_agreement": """SELECT round((sum(ra * rb) - sum(ra) * sum(rb) / count(*)) / sqrt((sum(ra * ra) - sum(ra) * sum(ra) / count(*)) * (sum(rb * rb) - sum(rb) * sum(rb) / count(*))), 6) AS spearman, round(avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0.0 END), 8) AS agreement, count(*) AS n
        FROM (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM (
          SELECT ticker, round(avg(raw_score), 6) AS a, round(avg(CASE WHEN group_key = 'click' THEN raw_score ELSE -raw_score / 2 END), 6) AS b FROM {news} GROUP BY ticker) s) q""",
    "best_by_arm": f"SELECT arm, model, round(mean, 4) AS mean_metric, n FROM (SELECT arm, model, mean, n, row_number() OVER (PARTITION BY arm ORDER BY mean DESC, model) AS rn FROM (SELECT arm, model, avg(metric) AS mean, count(*) AS n FROM {_CUBE} c GROUP BY arm, model) q) z WHERE rn = 1",
    "metric_cube": f"SELECT arm, model, backend, round(sum(metric), 2) AS total, round(min(metric), 4) AS lo, round(max(metric), 4) AS hi, count(*) AS n FROM {_CUBE} c GROUP BY CUBE (arm, model, backend)",
    "backend_spread": f"SELECT model, round(max(m) - min(m), 4) AS spread FROM (SELECT model, backend, avg(metric) AS m FROM {_CUBE} c GROUP BY model, backend) q GROUP BY model",
    "position_rollup": """SELECT p_brand AS symbol, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END), 4) AS quantity, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END), 2) AS cash,
        round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) / nullif(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 0), 4) AS average_price FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY p_brand""",
    "open_risk": "SELECT p_brand AS symbol, round(abs(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)) * avg(l_extendedprice / l_quantity * l_discount), 2) AS risk FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand",
    "ticker_summary": "SELECT ticker, round(avg(raw_score), 8) AS score, round(avg(p_pos), 8) AS p_pos, round(avg(p_neg), 8) AS p_neg, count(*) AS n FROM {news} GROUP BY ticker ORDER BY avg(raw_score) DESC, count(*) DESC",
    "latest_per_ticker": "SELECT ticker, article_id, round(raw_score, 8) AS raw_score FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY valid_time DESC, article_id DESC) AS rn FROM {news}) q WHERE rn = 1",
    "top_signals": "SELECT ticker, round(s, 8) AS signal FROM (SELECT ticker, avg(raw_score) AS s FROM {news} GROUP BY ticker) q WHERE abs(s) >= 0.05 ORDER BY abs(s) DESC, ticker LIMIT 20",
    "recent_candles": "SELECT asset, date, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, round(100 * (close / prev - 1), 6) AS change FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY asset ORDER BY date), open) AS prev, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS rn FROM {bars}) q WHERE rn <= 20",
    "moving_average": "SELECT asset, date, round(avg(close) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS ma20 FROM {bars}",
    "rebased_path": f"SELECT date, round(exp(lv - first_value(lv) OVER (ORDER BY date)), 8) AS rebased FROM {_EQ} e",
    "drawdown": f"SELECT date, round(exp(lv) / max(exp(lv)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 8) AS drawdown FROM {_EQ} e",
    "rolling_sharpe": f"SELECT date, CASE WHEN count(r) OVER w = 63 THEN round(avg(r) OVER w / nullif(stddev_samp(r) OVER w, 0) * sqrt(252), 5) END AS sharpe FROM (SELECT date, exp(lv - lag(lv) OVER (ORDER BY date)) - 1 AS r FROM {_EQ} e) q WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)",
    "monthly_returns": f"SELECT y, m, round(exp(l - coalesce(lag(l) OVER (ORDER BY y, m), l0)) - 1, 8) AS ret FROM (SELECT year(date) AS y, month(date) AS m, max_by(lv, date) AS l, (SELECT min_by(lv, date) FROM {_EQ} e0) AS l0 FROM {_EQ} e GROUP BY year(date), month(date)) q",
    "sparse_series": "SELECT indicator, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM {macro} GROUP BY indicator HAVING count(*) < 2000",
    "pooled_variance": f"SELECT round(var_samp(r), 10) AS variance, count(r) AS n FROM {_RET} q WHERE r IS NOT NULL",
    "lexicon_sentiment": "SELECT doc_id, round(s, 4) AS sentiment, round(CASE WHEN s > 0 THEN c WHEN s < 0 THEN (1 - c) * 0.35 ELSE 0.3 END, 4) AS p_pos, round(CASE WHEN s < 0 THEN c WHEN s > 0 THEN (1 - c) * 0.35 ELSE 0.3 END, 4) AS p_neg FROM (SELECT doc_id, s, least(0.82, 0.34 + abs(s) * 0.4) AS c FROM (SELECT doc_id, greatest(-1.0, least(1.0, 0.18 * ("
    + " + ".join(f"CASE WHEN t LIKE '% {w} %' THEN 1 ELSE 0 END" for w in POSITIVE) + ") - 0.18 * (" + " + ".join(f"CASE WHEN t LIKE '% {w} %' THEN 1 ELSE 0 END" for w in NEGATIVE)
    + "))) AS s FROM (SELECT doc_id, concat(' ', REPLACE_ALL(lower(text); '[^a-z]+'; ' '), ' ') AS t FROM {documents}) a) b) c2",
    "entity_masking": "SELECT n_nationkey, REPLACE_ALL(n_name; '(?i)an|ia'; '[ENTITY]') AS masked, upper(trim(n_name)) AS symbol FROM {nation}",
    "word_gate": "SELECT source, count(*) AS n FROM {documents} WHERE length(text) - length(replace(text, ' ', '')) >= 79 GROUP BY source",
    "distinct_texts_scored_once": "SELECT count(*) AS n_rows, count(DISTINCT text) AS n_calls FROM {documents}",
    "liquidity_rank": "SELECT asset, rank() OVER (ORDER BY mdv DESC) AS liquidity_rank FROM (SELECT asset, round(PCT(close * volume; 0.5), 4) AS mdv FROM {bars} GROUP BY asset) q",
    "beta_to_market": f"SELECT asset, round(covar_samp(r, m) / nullif(var_samp(m), 0), 4) AS beta FROM (SELECT asset, r, avg(r) OVER (PARTITION BY date) AS m FROM {_RET} q) z WHERE r IS NOT NULL GROUP BY asset",
}


def _spelled(sql: str) -> str:
    sql = re.sub(r"(?<![\w.#'])(\d+\.\d+)(?![\de])", r"\1e0", re.sub(r"PCT\(([^;]+?); ([^)]+)\)", r"quantile_cont(\1, \2)", sql))  # doubles, not decimals
    return re.sub(r"REPLACE_ALL\((.+?); ('.*?'); ('.*?')\)", r"regexp_replace(\1, \2, \3, 'g')", sql)


def _whole(sql: str) -> str:
    ctes = [INPUTS[n] for n in sorted(set(re.findall(r"\{(\w+)\}", sql))) if n in INPUTS]
    body = _spelled(re.sub(r"\{(\w+)\}", r"\1", sql))
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


REPORT_ORACLES: dict[str, str] = {name: _whole(sql) for name, sql in _SQL.items()}
