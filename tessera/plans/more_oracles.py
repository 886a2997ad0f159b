"""DuckDB SQL of the queries in ``more.py``, written apart from the Spark operators."""

from __future__ import annotations

from ..sources.panels import BARS_SQL, MACRO_SQL, NEWS_SQL
from .oracles import FEATURES, MARKET, PRICES, PRIOR, RET, SEGMENTS

WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_RUNNING = "exp(coalesce(sum(ln(1 + net)) OVER (ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"


def _book(name: str, bps: int, holding: int = 5) -> str:
    """t, value, turnover, gross, net, cost of the equal-weight book."""
    return f"""{name}_s AS (SELECT *, (1 + gross) * (1 - turnover * {bps} / 10000.0) - 1 AS net FROM seg),
{name}_v AS (SELECT *, {_RUNNING} AS start FROM {name}_s),
{name} AS (SELECT 0 AS t, 1.0::DOUBLE AS value, NULL::DOUBLE AS turnover, NULL::DOUBLE AS gross, NULL::DOUBLE AS net, NULL::DOUBLE AS cost
  UNION ALL SELECT p.t, CASE WHEN p.t = v.t1 THEN start * (1 + net) ELSE start * avg(p.price / b.price) END, CASE WHEN p.t = v.t1 THEN turnover END, CASE WHEN p.t = v.t1 THEN gross END, CASE WHEN p.t = v.t1 THEN net END, CASE WHEN p.t = v.t1 THEN gross - net END
  FROM {name}_v v JOIN pp p ON p.t > v.t0 AND p.t <= v.t1 JOIN pp b ON b.asset = p.asset AND b.t = v.t0 GROUP BY p.t, v.t0, v.t1, start, net, turnover, gross)"""


RETURNS = f"{PRICES}, lr AS (SELECT asset, t, ln(price) - lag(ln(price)) OVER (PARTITION BY asset ORDER BY t) AS r FROM pp)"
AT = "ats AS (SELECT DISTINCT t AS t0 FROM pp WHERE t >= 60 AND t % 5 = 0 AND t <= (SELECT max(t) FROM pp) - 5)"
CELLS = f"{RETURNS}, {AT}, cell AS (SELECT t0 AS t, a.asset AS a, b.asset AS b, avg(a.r) AS mu_a, avg(b.r) AS mu_b, covar_samp(a.r, b.r) AS cov FROM ats JOIN lr a ON a.t > t0 - 60 AND a.t <= t0 AND a.r IS NOT NULL JOIN lr b ON a.t = b.t AND b.r IS NOT NULL GROUP BY t0, a.asset, b.asset), own AS (SELECT t, a AS asset, mu_a AS mu, cov AS v FROM cell WHERE a = b)"
OUTCOME = f"{RETURNS}, {AT}, fm AS (SELECT t0 AS t, asset, 5 * avg(r) AS mu, 5 * var_samp(r) AS v FROM ats JOIN lr ON lr.t > t0 - 60 AND lr.t <= t0 AND r IS NOT NULL GROUP BY t0, asset), oc AS (SELECT f.t, f.asset, f.mu, f.v, ln(q.price / p.price) AS target FROM fm f JOIN pp p ON p.asset = f.asset AND p.t = f.t JOIN pp q ON q.asset = f.asset AND q.t = f.t + 5)"
_N = lambda t, c: f"(length({t}) - length(replace({t}, '{c}', '')))"
_SC = lambda t: f"coalesce(({_N(t, 's')} - {_N(t, 'e')})::DOUBLE / nullif({_N(t, 's')} + {_N(t, 'e')}, 0), 0)"
GAPS = f"""nm AS (SELECT doc_id, source, lang, source || ' ' || text || ' ' || upper(source) AS a FROM documents WHERE text IS NOT NULL),
mk2 AS (SELECT *, regexp_replace(a, '(?i)' || regexp_escape(source), '[ENTITY]', 'g') AS b FROM nm),
fg AS (SELECT source, arg_min(lang, doc_id) AS grp FROM documents WHERE text IS NOT NULL GROUP BY source),
gap AS (SELECT doc_id, source AS ticker, grp AS group_key, {_SC('a')} - {_SC('b')} AS gap FROM mk2 JOIN fg USING (source))"""
FINAL = f"""{PRIOR}, lt AS (SELECT a.article_id, coalesce(median(b.s0), 0) AS lt, count(b.s0) AS nt FROM pr a LEFT JOIN pr b ON a.ticker = b.ticker AND b.valid_time < a.valid_time AND b.valid_time >= a.valid_time - INTERVAL 60 DAY GROUP BY a.article_id),
lg AS (SELECT a.article_id, coalesce(median(b.s0), 0) AS lg FROM pr a LEFT JOIN pr b ON a.group_key = b.group_key AND b.valid_time < a.valid_time AND b.valid_time >= a.valid_time - INTERVAL 60 DAY GROUP BY a.article_id),
n1 AS (SELECT pr.*, nt / (nt + 20.0) AS w, s0 - (nt / (nt + 20.0) * lt + (1 - nt / (nt + 20.0)) * lg) AS s1 FROM pr JOIN lt USING (article_id) JOIN lg USING (article_id)),
fin AS (SELECT article_id, group_key, round(CASE WHEN count(*) OVER g < 3 THEN s1 ELSE (s1 - avg(s1) OVER g) / greatest(stddev_pop(s1) OVER g, 0.000001) END, 5) AS f FROM n1 WINDOW g AS (PARTITION BY CAST(valid_time AS DATE), group_key))"""
POOLED = f"""{BARS_SQL}, {RET}, st AS (SELECT asset, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM ret GROUP BY asset HAVING count(ret) >= 60 AND stddev_samp(ret) > 1e-12), z AS (SELECT (ret - m) / s AS z FROM ret JOIN st USING (asset) WHERE ret IS NOT NULL)"""
COVERED = "cov AS (SELECT p_brand AS asset FROM part GROUP BY p_brand HAVING round(avg(p_retailprice), 6) > (SELECT round(avg(p_retailprice), 6) FROM part))"
UNIVERSE = f"{BARS_SQL}, {COVERED}, liq AS (SELECT asset, median(adj_close * volume) AS mdv FROM bars SEMI JOIN cov USING (asset) WHERE date <= DATE '1996-12-31' GROUP BY asset), uni AS (SELECT asset FROM liq ORDER BY mdv DESC, asset LIMIT 8)"
LABELS = f"{BARS_SQL}, {FEATURES}, lab AS (SELECT asset, date, coalesce(abs(round(z_ret, 5)), 0) AS strength, CASE WHEN round(z_ret, 5) > 1 THEN 'BUY' WHEN round(z_ret, 5) < -1 THEN 'SELL' ELSE 'HOLD' END AS signal FROM features)"
SPLITS = lambda days: f"""dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM {days})),
ll AS (SELECT *, CASE WHEN date >= DATE '1997-01-01' THEN 'test' WHEN t < round_even((SELECT count(*) FROM dd WHERE date < DATE '1997-01-01') * 0.8, 0) THEN 'train' ELSE 'val' END AS split FROM dd),
pu AS (SELECT *, min(split) OVER w = max(split) OVER w AND count(*) OVER w = 6 AS ok FROM ll WINDOW w AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
kt AS (SELECT *, min(t) OVER (PARTITION BY split) AS first FROM pu WHERE ok AND t >= 29), spl AS (SELECT t, date, split FROM kt WHERE split = 'train' OR t >= first + 5)"""  # noqa: E731
CUBE = """cube AS (SELECT r_name AS selection, c_mktsegment AS sentiment, o_orderstatus AS distribution, [0, 5, 15, 40][o_orderkey % 4 + 1] AS cost_bps, [5, 10, 21][o_orderkey % 3 + 1] AS holding, substr(o_orderpriority, 1, 1) AS model, o_totalprice / 100000 AS net
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ORDERS = """po AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_shipdate AS time, 'P' || l_partkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'Sell' ELSE 'Buy' END AS side, l_quantity / 100 AS qty, l_extendedprice / l_quantity AS price,
  CASE WHEN l_quantity > 49 THEN 'Filled' WHEN l_quantity > 48 THEN 'PartiallyFilled' WHEN l_quantity > 47 THEN 'Submitted' WHEN l_quantity > 46 THEN 'Rejected' ELSE 'Cancelled' END AS status, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS dir FROM lineitem),
qt AS (SELECT 'P' || p_partkey AS symbol, p_retailprice * (0.9 + p_size * 0.004) AS last FROM part),
le AS (SELECT symbol, count(*) AS trades, count_if(pnl > 0)::BIGINT AS wins, count_if(pnl < 0)::BIGINT AS losses, sum(pnl) AS pnl FROM (SELECT symbol, (last - price) * qty * dir AS pnl FROM po JOIN qt USING (symbol) WHERE status = 'Filled') GROUP BY symbol),
hold AS (SELECT symbol, sum(dir * CASE WHEN status = 'Filled' THEN qty WHEN status = 'PartiallyFilled' THEN qty / 2 ELSE 0 END) AS quantity FROM po GROUP BY symbol)"""
SIGNALS = """sg AS (SELECT 'P' || p_partkey AS symbol, avg(s) AS s FROM (SELECT p_partkey, round((p_size - 25.5) / 60, 6) AS s FROM part UNION ALL SELECT p_partkey, round((p_retailprice - 1500) / 4000, 6) FROM part WHERE p_size % 5 <> 0) GROUP BY p_partkey)"""


def _cycle(name: str, trades: int, book: int, notional: str, short: bool) -> str:
    return f"""{name}_b AS (SELECT symbol, s FROM sg WHERE abs(s) >= 0.05 AND symbol NOT IN (SELECT symbol FROM po WHERE time >= TIMESTAMP '2001-10-19 23:59:30') ORDER BY abs(s) DESC, symbol LIMIT {trades}),
{name}_c AS (SELECT b.symbol, abs(s) AS strength, greatest(-1, least(1, s + CASE WHEN wins IS NULL THEN 0 ELSE greatest(-0.05, least(0.05, 0.01 * (wins - losses))) END)) AS signal, coalesce(quantity, 0) AS pos, last FROM {name}_b b JOIN qt USING (symbol) LEFT JOIN hold USING (symbol) LEFT JOIN le USING (symbol)
  WHERE b.symbol NOT IN (SELECT symbol FROM po WHERE side = 'Buy' AND status IN ('Submitted', 'PartiallyFilled'))),
{name}_d AS (SELECT *, CASE WHEN signal > 0 THEN 'Buy' ELSE 'Sell' END AS side FROM {name}_c WHERE NOT (pos > 0 AND signal > 0) AND NOT (pos < 0 AND signal <= 0){'' if short else ' AND NOT (signal <= 0 AND pos <= 0)'}),
{name}_e AS (SELECT *, count_if(pos = 0) OVER (ORDER BY strength DESC, symbol) AS nth FROM {name}_d),
{name}_f AS (SELECT *, least((SELECT 1e9 - sum(CASE WHEN status NOT IN ('Cancelled', 'Rejected') THEN dir * qty * price ELSE 0 END) FROM po) * 0.01 / (last * 0.02){notional}) AS wanted FROM {name}_e WHERE pos <> 0 OR nth + (SELECT count(*) FROM hold WHERE quantity <> 0) <= {book}),
{name} AS (SELECT *, round(CASE WHEN pos = 0 THEN least(wanted, 500 / last, 100) ELSE least(wanted, abs(pos)) END, 4) AS qty, CASE WHEN side = 'Buy' THEN 1 ELSE -1 END AS up FROM {name}_f)"""


_PLACED = "symbol, side, qty, round(last, 4) AS price, round(signal, 6) AS signal, round(qty * last * 0.02, 2) AS risk_amount, round(last * (1 - up * 0.02), 4) AS stop_loss, round(last * (1 + up * 0.03), 4) AS take_profit"
_SPEAR = lambda x, y: f"(sum(r{x} * r{y}) - sum(r{x}) * sum(r{y}) / count(*)) / sqrt((sum(r{x} * r{x}) - sum(r{x}) * sum(r{x}) / count(*)) * (sum(r{y} * r{y}) - sum(r{y}) * sum(r{y}) / count(*)))"
_RANK = lambda x, w="": f"rank() OVER ({w} ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}{', t' if w else ''}) - 1) / 2.0"
_UNIT = "list_transform(v, lambda x: x / nullif(sqrt(list_sum(list_transform(v, lambda y: y * y))), 0))"

MORE: dict[str, str] = {
    "name_fallback": "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END), ''), CASE WHEN doc_id % 2 = 0 THEN source END, 's' || doc_id) AS name FROM documents",
    "article_ids": """WITH t AS (SELECT CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE sha256(trim(text) || '|2024-01-02T10:00:00Z') END AS article_id, upper(source) AS s FROM documents WHERE trim(text) <> '')
      SELECT article_id, sum(CASE WHEN s = 'B' THEN 1 ELSE 2 END)::BIGINT AS n, 'EX:NA' AS group_key FROM t GROUP BY article_id""",
    "canonical_symbols": "SELECT s_suppkey, upper(s_name) AS symbol FROM supplier",
    "scored_text": "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 AND source <> '' AND trim(text) <> '' THEN 'Company background: ' || source || chr(10) || chr(10) || 'News: ' || trim(text) ELSE text END) AS text_md5 FROM documents",
    "probability_cleanup": """WITH x AS (SELECT l_orderkey, l_linenumber, greatest(l_discount - 0.03::DOUBLE, 0) AS a, greatest(l_tax - 0.05::DOUBLE, 0) AS b, CASE WHEN l_quantity > 25 THEN 0 ELSE 0.02::DOUBLE END AS c FROM lineitem), y AS (SELECT *, a + b + c AS s FROM x)
      SELECT l_orderkey, l_linenumber, round(CASE WHEN s > 0 THEN a / s ELSE 0 END, 7) AS p_pos, round(CASE WHEN s > 0 THEN b / s ELSE 0 END, 7) AS p_neg, round(CASE WHEN s > 0 THEN c / s ELSE 1 END, 7) AS p_neu, round(CASE WHEN s > 0 THEN a / s - b / s ELSE 0 END, 7) AS raw_score FROM y""",
    "label_aliases": "SELECT ['positive', 'negative', 'neutral', 'positive', 'negative', NULL][event_id % 6 + 1] AS class, count(*) AS n FROM events GROUP BY ALL",
    "masked_articles": """WITH a AS (SELECT doc_id, source, split_part(trim(text), ' ', 1) AS nm, concat_ws(' ', upper(source), text, source) AS t FROM documents),
      b AS (SELECT *, CASE WHEN coalesce(nm, '') = '' THEN t ELSE regexp_replace(t, '(?i)' || regexp_escape(nm), '[ENTITY]', 'g') END AS u FROM a), c AS (SELECT doc_id, regexp_replace(u, '(?i)' || regexp_escape(source), '[ENTITY]', 'g') AS u FROM b) SELECT doc_id, length(u) AS n_chars, md5(u) AS text_md5 FROM c""",
    "text_scores_once": f"SELECT doc_id, CAST(len({WORDS.format('text')}) AS BIGINT) AS score FROM documents",
    "first_seen_texts": "SELECT min(doc_id) AS first, md5(text) AS text_md5 FROM documents GROUP BY text",
    "iso_times": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE epoch(date_trunc('second', ts)) END AS seconds FROM events",
    "number_coercion": "WITH k AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events) SELECT event_id, k, coalesce(k, 0.0) AS k_or_zero FROM k",
    "text_enrichment": "WITH o AS (SELECT text, min(doc_id) AS i FROM documents GROUP BY text) SELECT d.doc_id, CASE WHEN i % 3 = 0 OR i IS NULL OR d.text IS NULL THEN source ELSE md5(d.text) END AS summary, CASE WHEN d.text IS NULL THEN '' ELSE 'event' END AS qwen_event, CASE WHEN d.text IS NULL THEN '' ELSE CAST(i AS VARCHAR) END AS qwen_rationale, '' AS qwen_signal_explanation FROM documents d LEFT JOIN o ON d.text = o.text",
    "token_report": f"SELECT source, CAST(sum(n) AS BIGINT) AS n_words, count_if(n > 1024)::BIGINT AS n_over FROM (SELECT source, len({WORDS.format('text')}) AS n FROM documents WHERE text IS NOT NULL) GROUP BY source",
    "story_features": f"""WITH RECURSIVE s AS (SELECT label AS asset, vec_id AS id, DATE '2024-01-01' + CAST(vec_id % 28 AS INT) AS day, round(CAST(embedding[1] AS DOUBLE), 6) AS sentiment, CASE WHEN vec_id % 5 <> 0 THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
      dy AS (SELECT DISTINCT asset, DATE '2024-01-01' + CAST(i AS INT) AS date FROM s, range(1, 30) r(i)), w AS (SELECT dy.asset, date, id, sentiment, {_UNIT} AS u FROM dy JOIN s ON s.asset = dy.asset AND day >= date - 7 AND day < date),
      ed AS (SELECT a.asset, a.date, a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS c FROM w a JOIN w b ON a.asset = b.asset AND a.date = b.date AND a.u IS NOT NULL AND b.u IS NOT NULL),
      re AS (SELECT asset, date, id, id AS r FROM w WHERE u IS NOT NULL UNION SELECT re.asset, re.date, re.id, ed.b FROM re JOIN ed ON ed.asset = re.asset AND ed.date = re.date AND ed.a = re.r AND c >= 0.4),
      cp AS (SELECT asset, date, id, min(r) AS k FROM re GROUP BY asset, date, id), nr AS (SELECT x.asset, x.date, x.k, x.id, round(sum(c), 9) AS near FROM cp x JOIN cp y ON x.asset = y.asset AND x.date = y.date AND x.k = y.k JOIN ed ON ed.asset = x.asset AND ed.date = x.date AND ed.a = x.id AND ed.b = y.id GROUP BY ALL),
      rp AS (SELECT asset, date, id FROM (SELECT *, row_number() OVER (PARTITION BY asset, date, k ORDER BY near DESC, id) AS n FROM nr) WHERE n = 1 UNION ALL SELECT asset, date, id FROM w WHERE u IS NULL),
      g AS (SELECT asset, date, count(*) AS n, avg(sentiment) AS m FROM rp JOIN w USING (asset, date, id) GROUP BY asset, date)
      SELECT dy.asset, dy.date, coalesce(n, 0) AS n_stories, round(coalesce(m, 0), 12) AS mean_sentiment, round(ln(1 + coalesce(n, 0)), 12) AS log_n_stories FROM dy LEFT JOIN g USING (asset, date)""",
    "forecast_errors": f"WITH {OUTCOME}, e AS (SELECT round(mu, 9) AS m, round(target, 9) AS r FROM oc) SELECT round(avg(abs(m - r)), 6) AS mae, round(sqrt(avg((m - r) ** 2)), 6) AS rmse, round(avg(CASE WHEN sign(m) = sign(r) THEN 1.0 ELSE 0.0 END), 6) AS directional_accuracy, count(*) AS n FROM e",
    "information_coefficient": f"""WITH {OUTCOME}, k AS (SELECT t, round(mu, 9) AS m, round(target, 9) AS r FROM oc), q AS (SELECT t, m, r, {_RANK('m', 'PARTITION BY t')} AS rm, {_RANK('r', 'PARTITION BY t')} AS rr FROM k)
      SELECT t, round(corr(m, r), 5) AS ic, round(corr(rm, rr), 5) AS rank_ic FROM q GROUP BY t""",
    "interval_coverage": f"WITH {OUTCOME} SELECT round(avg(CASE WHEN abs(target - mu) <= 1.6448536269514722 * sqrt(v) THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n FROM oc",
    "moment_stats": f"""WITH {CELLS}, l AS (SELECT t, avg(mu) AS mean_level, stddev_pop(mu) AS dispersion, max(v) AS max_variance, min(v) AS min_variance FROM own GROUP BY t), c AS (SELECT cell.t, avg(cov / sqrt(x.v * y.v)) AS mc FROM cell JOIN own x ON x.t = cell.t AND x.asset = a JOIN own y ON y.t = cell.t AND y.asset = b WHERE a <> b GROUP BY cell.t)
      SELECT t, round(mean_level, 7) AS mean_level, round(dispersion, 7) AS dispersion, round(max_variance, 7) AS max_variance, round(min_variance, 7) AS min_variance, round(mc, 7) AS mean_correlation FROM l JOIN c USING (t)""",
    "lognormal_covariance": f"WITH {CELLS} SELECT cell.t, a, b, round(exp(mu_a + mu_b + (x.v + y.v) / 2) * (exp(cov) - 1), 8) AS cov FROM cell JOIN own x ON x.t = cell.t AND x.asset = a JOIN own y ON y.t = cell.t AND y.asset = b",
    "total_covariance": f"""WITH {RETURNS}, {AT}, dr AS (SELECT t0 AS t, k, a.asset AS a, b.asset AS b, avg(a.r) AS ma, avg(b.r) AS mb, covar_samp(a.r, b.r) AS c FROM ats, (VALUES (60), (50), (40)) w(k) JOIN lr a ON a.t > t0 - k AND a.t <= t0 AND a.r IS NOT NULL JOIN lr b ON a.t = b.t AND b.r IS NOT NULL GROUP BY ALL)
      SELECT t, a, b, round(avg(c), 9) AS aleatoric, round(covar_samp(ma, mb), 9) AS epistemic, round(avg(c) + covar_samp(ma, mb), 9) AS total FROM dr GROUP BY t, a, b""",
    "low_rank_covariance": """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), i AS (SELECT id, v, unnest(range(8)) AS i FROM e), j AS (SELECT *, unnest(range(8)) AS j FROM i)
      SELECT id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(list_dot_product(v[i * 8 + 1 : i * 8 + 8], v[j * 8 + 1 : j * 8 + 8]) + CASE WHEN i = j THEN ln(1 + exp(v[i + 1])) + 0.0001 ELSE 0 END, 6) AS value FROM j""",
    "batch_diagnostics": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS loss FROM orders GROUP BY o_orderpriority",
    "gap_by_ticker": f"WITH {GAPS} SELECT ticker, round(avg(gap), 7) AS prior, count(*) AS n FROM gap GROUP BY ticker",
    "gap_by_group": f"WITH {GAPS} SELECT group_key, round(avg(gap), 7) AS prior, count(*) AS n FROM gap GROUP BY group_key",
    "gap_summary": f"WITH {GAPS} SELECT count(*) AS n, round(avg(gap), 7) AS mean, round(stddev_pop(gap), 7) AS std, round(min(gap), 7) AS lowest, round(max(gap), 7) AS highest, count(DISTINCT ticker) AS n_tickers, count(DISTINCT group_key) AS n_groups FROM gap",
    "causality_audit": "WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)) SELECT count(*) AS n_past, 0.0::DOUBLE AS max_delta FROM events WHERE CAST(ts AS DATE) < (SELECT day FROM d WHERE i = floor(n * 0.8))",
    "same_sign_alerts": f"WITH {FINAL}, g AS (SELECT group_key, count(*) AS n, avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END) AS p FROM fin WHERE f <> 0 GROUP BY group_key) SELECT group_key, n, round(greatest(p, 1 - p), 7) AS share, greatest(p, 1 - p) > 0.6 AS alert FROM g",
    "sanity_sentences": "SELECT unnest(string_split('approval approved beat beats bullish contract gain growth improve improves launch outperform partnership profit positive record raised strong surge upgrade', ' ')) || ' reported today' AS text, 'pos' AS expect, 'pos' AS dominant, 0.9::DOUBLE AS top, true AS ok",
    "normality": f"""WITH {POOLED}, m AS (SELECT count(z)::DOUBLE AS n, avg(z) AS a FROM z), c AS (SELECT any_value(n) AS n, avg((z - a) ** 3) / avg((z - a) ** 2) ** 1.5 AS g1, avg((z - a) ** 4) / avg((z - a) ** 2) ** 2 - 3 AS g2 FROM z, m),
      t1 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / 6 / (n - 2)) AS y, sqrt(2 * (3 * (n ** 2 + 27 * n - 70) * (n + 1) * (n + 3) / (n - 2) / (n + 5) / (n + 7) / (n + 9) - 1)) - 1 AS w2, (g2 + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (n + 1) ** 2 / (n + 3) / (n + 5)) AS x,
        6 * (n ** 2 - 5 * n + 2) / (n + 7) / (n + 9) * sqrt(6 * (n + 3) * (n + 5) / n / (n - 2) / (n - 3)) AS h FROM c),
      t2 AS (SELECT *, asinh(y * sqrt((w2 - 1) / 2)) / sqrt(ln(sqrt(w2))) AS z1, 6 + 8 / h * (2 / h + sqrt(1 + 4 / h ** 2)) AS b FROM t1), t3 AS (SELECT *, (1 - 2 / 9 / b - cbrt((1 - 2 / b) / (1 + x * sqrt(2 / (b - 4))))) / sqrt(2 / 9 / b) AS z2 FROM t2)
      SELECT n::BIGINT AS n, round(g1, 4) AS skew, round(g2, 4) AS kurtosis, round(z1 ** 2 + z2 ** 2, 4) AS k2, CASE WHEN abs(g1) < 0.5 AND abs(g2) < 1 THEN 'approximately normal' WHEN abs(g2) < 1 THEN CASE WHEN g1 > 0 THEN 'right-skewed' ELSE 'left-skewed' END
        WHEN abs(g1) < 0.5 THEN CASE WHEN g2 > 0 THEN 'heavy-tailed' ELSE 'light-tailed' END ELSE CASE WHEN g1 > 0 THEN 'right-skewed, ' ELSE 'left-skewed, ' END || CASE WHEN g2 > 0 THEN 'heavy-tailed' ELSE 'light-tailed' END END AS verdict FROM t3""",
    "quantile_quantile": f"""WITH {POOLED}, r AS (SELECT round(z, 6) AS z, row_number() OVER (ORDER BY round(z, 6)) AS i, count(*) OVER () AS n FROM z), p AS (SELECT (k - 0.5) / 20 AS p FROM range(1, 21) q(k)),
      th AS (SELECT unnest([0.025, 0.075, 0.125, 0.175, 0.225, 0.275, 0.325, 0.375, 0.425, 0.475]) AS p, unnest([-1.95996, -1.43953, -1.15035, -0.93459, -0.75542, -0.59776, -0.45376, -0.31864, -0.18912, -0.06271]) AS q)
      SELECT round(p.p, 5)::DOUBLE AS p, coalesce((SELECT q FROM th WHERE abs(th.p - p.p) < 1e-9), (SELECT -q FROM th WHERE abs(1 - th.p - p.p) < 1e-9))::DOUBLE AS theoretical, round((SELECT min(z) FROM r WHERE i >= p.p * n), 5) AS sample FROM p""",
    "universe_resolved": f"WITH {UNIVERSE} SELECT asset FROM uni",
    "universe_override": f"WITH {UNIVERSE}, wn AS (SELECT unnest(['BRAND#11', 'BRAND#34', 'NOPE']) AS asset) SELECT asset, asset IN (SELECT upper(asset) FROM liq) AS available FROM wn",
    "missing_indicators": f"WITH {MACRO_SQL} SELECT unnest(['AUTOMOBILE', 'BUILDING', 'GOLD', 'VIX']) AS indicator EXCEPT SELECT indicator FROM macro",
    "shared_assets": f"WITH {BARS_SQL}, {COVERED} SELECT asset FROM bars INTERSECT SELECT asset FROM cov",
    "filter_candidates": f"WITH {LABELS} SELECT asset, count(*) AS n_buys, round(avg(strength), 5) AS strength FROM lab WHERE signal = 'BUY' AND date <= DATE '1996-12-31' GROUP BY asset ORDER BY count(*) DESC, avg(strength) DESC, asset LIMIT 10",
    "label_coverage": f"WITH {LABELS} SELECT count(*) AS n, count_if(signal = 'BUY')::BIGINT AS n_buy, count_if(signal = 'SELL')::BIGINT AS n_sell, round(100.0 * count_if(signal <> 'HOLD')::BIGINT / count(*), 4) AS fired FROM lab",
    "mask_coverage": f"WITH {LABELS}, k AS (SELECT date, count_if(signal <> 'SELL')::BIGINT AS k FROM lab GROUP BY date) SELECT count(*) AS n, round(avg(k), 5) AS mean_kept, min(k) AS least_kept, max(k) AS most_kept, count_if(k = 0)::BIGINT AS n_empty FROM k",
    "signal_vectors": f"WITH {LABELS} SELECT date, string_agg(asset, ',' ORDER BY asset) AS assets, string_agg(CASE signal WHEN 'BUY' THEN '1' WHEN 'SELL' THEN '-1' ELSE '0' END, ',' ORDER BY asset) AS signals FROM lab GROUP BY date",
    "lookback_windows": f"WITH {BARS_SQL}, k AS (SELECT asset, date, ln(close) AS c FROM bars), w AS (SELECT asset, date, count(*) OVER w AS n, first_value(c) OVER w AS first, c AS last, avg(c) OVER w AS mean FROM k WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 29 PRECEDING)) SELECT asset, date, CAST(n AS INT) AS n, round(first, 7) AS first, round(last, 7) AS last, round(mean, 7) AS mean FROM w WHERE n = 30",
    "train_days": f"WITH {BARS_SQL}, {SPLITS('bars')} SELECT DISTINCT d.t FROM dd d JOIN spl s ON s.split = 'train' AND d.t BETWEEN s.t - 29 AND s.t",
    "subsample": f"WITH {NEWS_SQL} SELECT article_id, round(raw_score, 8) AS raw_score FROM news ORDER BY md5(article_id || '|7'), article_id LIMIT 500",
    "assembled_panel": f"""WITH {UNIVERSE}, ub AS (SELECT * FROM bars SEMI JOIN uni USING (asset)), cd AS (SELECT date FROM ub GROUP BY date HAVING count(DISTINCT asset) = (SELECT count(*) FROM uni)), {SPLITS('cd')}, {FEATURES},
      pf AS (SELECT asset, date, rsi FROM features SEMI JOIN uni USING (asset) SEMI JOIN cd USING (date)), st AS (SELECT avg(rsi) AS m, stddev_pop(rsi) AS s FROM pf WHERE date <= DATE '1996-12-31')
      SELECT spl.date, split, count(*) AS n_assets, round(sum(coalesce((rsi - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 0)), 4) AS rsi FROM spl JOIN pf USING (date), st GROUP BY spl.date, split""",
    "experiment_leaves": f"WITH {CUBE} SELECT selection, sentiment, CASE WHEN distribution = 'P' THEN 'unspecified' ELSE distribution END AS distribution, model, count(*) AS n, round(avg(net), 6) AS net FROM cube GROUP BY ALL",
    "grid_metrics": f"WITH {PRICES}, hs AS (SELECT unnest([5, 10, 21]) AS h), cs AS (SELECT unnest([0.0, 15.0, 40.0])::DOUBLE AS c), s0 AS (SELECT h, asset, t AS t0, lead(t) OVER w AS t1, lead(price) OVER w / price AS g FROM pp, hs WHERE t % h = 0 WINDOW w AS (PARTITION BY h, asset ORDER BY t)), s1 AS (SELECT * FROM s0 WHERE t1 IS NOT NULL), "
    "tot AS (SELECT h, t0, t1, avg(g) AS m, count(*) AS n FROM s1 GROUP BY ALL), dr AS (SELECT s1.h, s1.t1 AS t0, sum(abs(1.0 / n - g / m / n)) AS tv FROM s1 JOIN tot ON s1.t0 = tot.t0 AND s1.h = tot.h GROUP BY ALL), "
    "sg AS (SELECT tot.h, m, coalesce(tv, 1) AS tv FROM tot LEFT JOIN dr ON tot.t0 = dr.t0 AND tot.h = dr.h) SELECT h AS holding, c AS cost_bps, count(*) AS n, round(exp(sum(ln(m * (1 - tv * c / 10000)))) - 1, 6) AS cum_return_net, round(avg(tv), 6) AS avg_turnover FROM sg, cs GROUP BY h, c",
    "equal_weight_curve": f"WITH {SEGMENTS}, {_book('bk', 15)} SELECT t, round(value, 7) AS value, round(turnover, 7) AS turnover, round(cost, 7) AS cost FROM bk",
    "equal_weight_metrics": f"""WITH {SEGMENTS}, {_book('bk', 15)}, {_book('gb', 0)}, r AS (SELECT *, value / lag(value) OVER (ORDER BY t) - 1 AS r, value / max(value) OVER (ORDER BY t) - 1 AS dd FROM bk),
      a AS (SELECT arg_max(value, t) AS last, count(r) AS n, stddev_samp(r) AS sd, avg(r) AS mean, stddev_pop(CASE WHEN r < 0 THEN r END) AS down, min(dd) AS mdd, avg(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0.0 END) AS hit, avg(turnover) AS tv, sum(cost) AS cost FROM r)
      SELECT 'EW' AS strategy, round(last - 1, 5) AS cum_return_net, round((SELECT arg_max(value, t) FROM gb) - 1, 5) AS cum_return_gross, round(power(last, 252.0 / n) - 1, 5) AS annualized_return, round(sd * sqrt(252), 5) AS annualized_vol, round(mean / sd * sqrt(252), 5) AS sharpe, round((power(last, 252.0 / n) - 1) / (down * sqrt(252)), 5) AS sortino,
      round((power(last, 252.0 / n) - 1) / abs(mdd), 5) AS calmar, round(mdd, 5) AS max_drawdown, round(hit, 5) AS hit_rate, round(tv, 5) AS avg_turnover, round(cost, 5) AS total_costs, round(cost * 10 / 15, 5) AS transaction_costs, round(cost * 5 / 15, 5) AS slippage_costs, 1.0::DOUBLE AS gross_exposure, 1.0::DOUBLE AS net_exposure, 0.0::DOUBLE AS short_exposure, 1.0::DOUBLE AS leverage FROM a""",
    "blended_curve": f"WITH {PRICES}, r AS (SELECT t, price / lag(price) OVER (PARTITION BY asset ORDER BY t) - 1 AS r FROM pp), m AS (SELECT t, avg(r) AS r FROM r WHERE r IS NOT NULL GROUP BY t) SELECT t, round(sum(ln(1 + r)) OVER (ORDER BY t), 7) AS log_value FROM m",
    "backends_joined": f"WITH {NEWS_SQL} SELECT ticker, round(avg(raw_score), 7) AS a, round(avg(p_pos), 7) AS b, round(avg(-p_neg), 7) AS c, count(*) AS n FROM news GROUP BY ticker",
    "merged_aggregates": f"WITH {CUBE} SELECT selection, model, round(avg(net), 6) AS net, round(stddev_pop(net), 6) AS sd, count(*) AS n FROM cube GROUP BY selection, model",
    "parameter_sweeps": f"WITH {CUBE} SELECT 'cost_bps' AS swept, CAST(cost_bps AS VARCHAR) AS at, model, sentiment, round(avg(net), 6) AS mean, count(*) AS n FROM cube GROUP BY ALL UNION ALL SELECT 'holding', CAST(holding AS VARCHAR), model, sentiment, round(avg(net), 6), count(*) FROM cube GROUP BY ALL",
    "best_at_sweep": f"WITH {CUBE}, m AS (SELECT selection, holding, model, avg(net) AS mean, count(*) AS n FROM cube GROUP BY ALL) SELECT selection, holding, model, round(mean, 6) AS mean, n FROM m QUALIFY row_number() OVER (PARTITION BY selection, holding ORDER BY mean DESC, model) = 1",
    "summary_table": f"WITH {CUBE}, m AS (SELECT selection, model, avg(net) AS net FROM cube GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY selection ORDER BY net DESC, model) = 1) SELECT selection, model, round(net, 6) AS net FROM b UNION ALL SELECT 'naive', model, round(avg(net), 6) FROM cube GROUP BY model",
    "model_pivot": f"WITH {CUBE} SELECT model, " + ", ".join(f"round(avg(CASE WHEN selection = '{r}' THEN net END), 6) AS \"{r.replace(' ', '_')}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM cube GROUP BY model",
    "holding_pivot": f"WITH {CUBE} SELECT holding, " + ", ".join(f"round(avg(CASE WHEN model = '{m}' THEN net END), 6) AS model_{m}" for m in "12345") + " FROM cube GROUP BY holding",
    "reference_cell": f"WITH {CUBE} SELECT round(avg(net), 6) AS value FROM cube WHERE holding = 21",
    "backend_agreement": f"""WITH {NEWS_SQL}, s AS (SELECT ticker, round(avg(raw_score), 6) AS a, round(max(raw_score), 6) AS b, round(avg(p_pos - 0.3::DOUBLE), 6) AS c FROM news GROUP BY ticker), q AS (SELECT a, b, c, {_RANK('a')} AS ra, {_RANK('b')} AS rb, {_RANK('c')} AS rc FROM s)
      SELECT 'mean' AS a, 'top' AS b, round({_SPEAR('a', 'b')}, 6) AS spearman, round(avg((sign(a) = sign(b))::INT), 6) AS same_label, count(*) AS n FROM q UNION ALL SELECT 'mean', 'up', round({_SPEAR('a', 'c')}, 6), round(avg((sign(a) = sign(c))::INT), 6), count(*) FROM q UNION ALL SELECT 'top', 'up', round({_SPEAR('b', 'c')}, 6), round(avg((sign(b) = sign(c))::INT), 6), count(*) FROM q""",
    "class_ecdf": f"WITH {NEWS_SQL}, l AS (UNPIVOT (SELECT group_key, p_pos, p_neg, p_neu FROM news) ON p_pos, p_neg, p_neu INTO NAME class VALUE p), n AS (SELECT group_key, class, round(p, 2) AS x, count(*) AS n FROM l GROUP BY ALL) SELECT group_key, class, x, round(sum(n) OVER (PARTITION BY group_key, class ORDER BY x) / sum(n) OVER (PARTITION BY group_key, class), 7) AS share FROM n",
    "asset_summary": f"WITH {NEWS_SQL} SELECT ticker AS asset, count(*) AS n, round(avg(raw_score), 6) AS mean, round(median(raw_score), 6) AS median, round(stddev_samp(raw_score), 6) AS std, round(avg((raw_score > 0)::INT), 6) AS positive FROM news GROUP BY ticker",
    "stacked_sources": f"WITH {BARS_SQL}, {MACRO_SQL} SELECT 'macro' AS origin, indicator AS name, count(*) AS n, round(sum(round(adj_close, 4)), 2) AS value, NULL::DOUBLE AS volume FROM macro GROUP BY indicator UNION ALL SELECT 'bars', asset, count(*), NULL, round(sum(round(volume, 4)), 2) FROM bars GROUP BY asset UNION ALL SELECT 'nation', n_name, 1, NULL, NULL FROM nation",
    "paper_cycle": f"WITH {ORDERS}, {SIGNALS}, {_cycle('a', 20, 20, '', True)}, {_cycle('b', 40, 1000000, ', 400 / last', False)} SELECT 'full' AS book, {_PLACED} FROM a WHERE qty > 0 UNION ALL SELECT 'open', {_PLACED} FROM b WHERE qty > 0",
    "paper_exits": f"WITH {ORDERS}, h AS (SELECT *, price * (1 - 0.02::DOUBLE * dir) AS stop, price * (1 + 0.03::DOUBLE * dir) AS goal FROM po JOIN qt USING (symbol) WHERE status = 'Filled'), x AS (SELECT *, CASE WHEN dir > 0 THEN last <= stop ELSE last >= stop END AS s, CASE WHEN dir > 0 THEN last >= goal ELSE last <= goal END AS g FROM h) SELECT id, symbol, CASE WHEN dir > 0 THEN 'Sell' ELSE 'Buy' END AS side, round(qty, 4) AS qty, round(last, 4) AS price, CASE WHEN s THEN 'risk-stop' ELSE 'take-profit' END AS reason FROM x WHERE s OR g",
    "paper_positions": f"WITH {ORDERS} SELECT symbol, round(quantity, 6) AS quantity FROM hold",
    "paper_learning": f"WITH {ORDERS} SELECT symbol, trades, wins, losses, round(pnl, 7) AS pnl, round(greatest(-0.05, least(0.05, 0.01 * (wins - losses)))::DOUBLE, 4) AS bias FROM le",
    "learning_totals": f"WITH {ORDERS} SELECT sum(trades)::BIGINT AS trades, sum(wins)::BIGINT AS wins, sum(losses)::BIGINT AS losses, round(sum(round(pnl, 4)), 1) AS pnl FROM le",
    "mark_to_market": f"WITH {ORDERS} SELECT symbol, status, count(*) AS n, round(sum(round((coalesce(last, price) - price) * qty * dir, 9)), 4) AS pnl FROM po LEFT JOIN qt USING (symbol) GROUP BY symbol, status",
    "dashboard_risk": f"WITH {BARS_SQL}, v AS (SELECT asset, date, round(close, 6) AS v FROM bars WHERE close > 0), r AS (SELECT asset, v / lag(v) OVER (PARTITION BY asset ORDER BY date) - 1 AS r, v / max(v) OVER (PARTITION BY asset ORDER BY date) - 1 AS d FROM v) SELECT asset, round(avg(r) / stddev_pop(r) * sqrt(252), 2) AS sharpe, round(min(d) * 100, 2) AS drawdown FROM r GROUP BY asset",
    "aligned_betas": f"WITH {BARS_SQL}, {MACRO_SQL}, j AS (SELECT asset, indicator, date, close AS p, macro.adj_close AS q FROM bars JOIN macro USING (date)), r AS (SELECT asset, indicator, p / lag(p) OVER w - 1 AS x, q / lag(q) OVER w - 1 AS y FROM j WINDOW w AS (PARTITION BY asset, indicator ORDER BY date)) SELECT asset, indicator, count(*) AS n, round(covar_samp(x, y) / var_samp(y), 2) AS beta FROM r WHERE x IS NOT NULL GROUP BY asset, indicator",
    "trend_strength": f"WITH {BARS_SQL}, l AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= 5), t AS (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY date) AS pc FROM l), g AS (SELECT asset, (arg_max(close, date) / arg_min(close, date) - 1) * 100 AS ch, arg_max(close, date) AS lc, avg(CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END) AS tr FROM t GROUP BY asset) SELECT asset, round(least(100, abs(ch) * 20), 2) AS trend_strength, round(ch, 2) AS trend_change, round(tr / lc * 100, 2) AS atr FROM g",
    "period_bars": f"WITH {BARS_SQL}, p AS (SELECT unnest(['M1', 'M5', 'M15', 'M30', 'H1', 'H4', 'D1', 'W1', 'MN1', '1D', '1W', '1M']) AS period, unnest([1, 5, 15, 30, 60, 120, 1, 5, 22, 1, 5, 22]) AS k), l AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS i FROM bars) SELECT asset, period, count(*) AS n, round(arg_min(open, date), 9) AS open, round(max(high), 9) AS high, round(min(low), 9) AS low, round(arg_max(close, date), 9) AS close FROM l JOIN p ON i <= k GROUP BY asset, period",
    "watchlist": """WITH s AS (SELECT 'U' || user_id AS symbol, ts AS time, event_type AS headline, 'Analyzed news' AS source, 0 AS k FROM events UNION ALL SELECT 'U' || o_custkey, o_orderdate, o_orderpriority, 'Raw feed', 1 FROM orders),
      r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC, k, headline) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM s) SELECT symbol, n AS news_count, headline, epoch_us(time) AS news_date, source FROM r WHERE i = 1""",
    "review_panel": f"WITH {NEWS_SQL}, r AS (SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY article_id) <= 2) SELECT article_id, ticker, round(raw_score, 8) AS raw_score FROM r ORDER BY article_id LIMIT 12",
    "newest_news": "SELECT event_id AS article_id, user_id AS ticker FROM events ORDER BY ts DESC, event_id LIMIT 24",
    "sentiment_overview": f"WITH {NEWS_SQL}, s AS (SELECT group_key, CASE WHEN article_id % 9 <> 0 THEN raw_score ELSE 0 END AS s FROM news) SELECT group_key, round(avg(s), 7) AS mean_sentiment, round(avg((s > 0)::INT), 7) AS bullish_share, round(avg(s), 7) AS score FROM s GROUP BY group_key",
    "best_run": f"WITH {CUBE} SELECT selection, model, round(avg(net), 6) AS net FROM cube WHERE model <> '1' GROUP BY ALL ORDER BY avg(net) DESC, selection, model LIMIT 1",
    "csv_round_trip": "SELECT CAST(doc_id AS VARCHAR) AS id, '2024-01-02' AS day, md5(text) AS text_md5, NULL::VARCHAR AS isin FROM documents WHERE text IS NOT NULL",
    "contract_columns": f"WITH {NEWS_SQL} SELECT 'article_id,ticker,group_key,valid_time,raw_score,finbert_raw_score' AS columns, count(*) AS n, round(sum(raw_score), 4) AS total FROM news",
    "provider_candles": f"WITH {BARS_SQL} SELECT asset AS symbol, date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume FROM bars WHERE (date - DATE '1970-01-01') % 5 <> 0",
    "provider_news": "WITH t AS (SELECT doc_id, upper(lang) AS ticker, lang, trim(concat_ws('. ', CASE WHEN doc_id % 3 <> 0 THEN nullif(trim(source), '') END, CASE WHEN doc_id % 5 <> 0 THEN nullif(trim(text), '') END)) AS t FROM documents) SELECT CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE lang || '-' || (doc_id + 1600000000) END AS id, ticker, doc_id + 1600000000 AS seconds, md5(t) AS text_md5 FROM t WHERE t <> ''",
    "long_indicators": f"WITH {MACRO_SQL}, a AS (SELECT date, round(adj_close, 4) AS v FROM macro WHERE indicator = 'AUTOMOBILE'), b AS (SELECT date, round(adj_close, 4) AS v FROM macro WHERE indicator = 'BUILDING'), j AS (SELECT coalesce(a.date, b.date) AS date, CASE WHEN day(coalesce(a.date, b.date)) > 15 THEN a.v END AS x, b.v AS y FROM a FULL JOIN b ON a.date = b.date) SELECT 'AUTO' AS indicator, date, coalesce(x, y) AS adj_close FROM j WHERE coalesce(x, y) IS NOT NULL UNION ALL SELECT 'BUILD', date, y FROM j WHERE y IS NOT NULL",
}
