"""DuckDB SQL of the operator queries, written apart from the Spark operators."""

from __future__ import annotations

from ..operators.technical import impulse_norm
from ..sources.panels import BARS_SQL, MACRO_SQL, NEWS_SQL

_A = "PARTITION BY asset ORDER BY date"


def _w(n: int) -> str:
    return f"({_A} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {f}({x}) OVER {_w(n)} END"


RET = f"ret AS (SELECT asset, date, adj_close, ln(adj_close / lag(adj_close) OVER ({_A})) AS ret FROM bars)"
MARKET = "mk AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS market FROM ret)"
FEATURES = f"""f1 AS (SELECT *, ln(close / lag(close) OVER ({_A})) AS ret_close, ln(close / open) AS ret_oc, ln(open / lag(close) OVER ({_A})) AS ret_overnight, ln(adj_close / lag(adj_close) OVER ({_A})) AS ret_adj,
  ln(high / low) AS hl_range, ln(volume) - lag(ln(volume)) OVER ({_A}) AS vol_change, ln(volume) AS lv, ln(adj_close / lag(adj_close, 5) OVER ({_A})) AS mom_5, ln(adj_close / lag(adj_close, 20) OVER ({_A})) AS mom_20,
  adj_close - lag(adj_close) OVER ({_A}) AS da, lag(close) OVER ({_A}) AS pc FROM bars),
f2 AS (SELECT *, CASE WHEN da IS NOT NULL THEN greatest(da, 0) END AS up, CASE WHEN da IS NOT NULL THEN greatest(-da, 0) END AS dn, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM f1),
features AS (SELECT asset, date, ret_close, ret_oc, ret_overnight, ret_adj, hl_range, vol_change, abs(ret_adj) / nullif(close * volume, 0) AS amihud, mom_5, mom_20,
  {_roll('stddev_samp', 'ret_adj', 20)} AS roll_vol, {_roll('avg', 'ret_adj', 20)} AS roll_mean_ret, volume / {_roll('avg', 'volume', 20)} AS rel_volume,
  1 - 1 / (1 + {_roll('avg', 'up', 14)} / nullif({_roll('avg', 'dn', 14)}, 0)) AS rsi, {_roll('avg', 'tr', 14)} / close AS atr,
  (ret_adj - {_roll('avg', 'ret_adj', 20)}) / nullif({_roll('stddev_samp', 'ret_adj', 20)}, 0) AS z_ret, (lv - {_roll('avg', 'lv', 20)}) / nullif({_roll('stddev_samp', 'lv', 20)}, 0) AS z_volume,
  adj_close / {_roll('avg', 'adj_close', 20)} - 1 AS ma_ratio FROM f2)"""


def _ewm(x: str, span: int, n: str) -> str:
    b = f"(1 - 2.0 / {span + 1})"
    return f"CASE WHEN {x} IS NOT NULL AND {n} >= {span} THEN sum({x} * CASE WHEN {n} = 1 THEN 1 ELSE 2.0 / {span + 1} END * power({b}, 1 - {n})) OVER ({_A} ROWS UNBOUNDED PRECEDING) * power({b}, {n} - 1) END"


def _macd(src: str) -> str:
    return f"""m0 AS (SELECT *, count(path) OVER ({_A} ROWS UNBOUNDED PRECEDING) AS n FROM {src}),
m1 AS (SELECT *, {_ewm('path', 20, 'n')} - {_ewm('path', 50, 'n')} AS macd FROM m0),
m2 AS (SELECT *, count(macd) OVER ({_A} ROWS UNBOUNDED PRECEDING) AS k FROM m1),
macd AS (SELECT *, {_ewm('macd', 15, 'k')} AS macd_signal, macd - {_ewm('macd', 15, 'k')} AS hist FROM m2)"""


_W126 = _w(126)
OLS = f"""o0 AS (SELECT *, CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN market END AS x FROM mk),
o1 AS (SELECT *, count(y) OVER {_W126} AS c, covar_samp(y, x) OVER {_W126} AS cv, var_samp(x) OVER {_W126} AS vx, var_samp(y) OVER {_W126} AS vy, avg(y) OVER {_W126} AS my, avg(x) OVER {_W126} AS mx FROM o0),
ols AS (SELECT asset, date, beta, alpha, ret - alpha - beta * market AS resid, greatest(0, least(1, beta * beta * vx / nullif(vy, 0))) AS resid_r2, CASE WHEN c = 126 THEN sqrt(vy) END AS sigma
  FROM (SELECT *, CASE WHEN c = 126 THEN cv / nullif(vx, 0) END AS beta, CASE WHEN c = 126 THEN my - cv / nullif(vx, 0) * mx END AS alpha FROM o1) WHERE TRUE),
olsn AS (SELECT asset, date, beta, alpha, resid, CASE WHEN beta IS NOT NULL THEN resid_r2 END AS resid_r2, sigma FROM ols)"""
IMACD = f"""{OLS}, opath AS (SELECT *, CASE WHEN resid IS NOT NULL THEN sum(resid) OVER ({_A} ROWS UNBOUNDED PRECEDING) END AS path FROM olsn), {_macd('opath')},
im AS (SELECT asset, date, hist * sqrt(1 - resid_r2) / nullif(sigma * {impulse_norm(20, 50, 15)!r}, 0) AS imacd, resid_r2 FROM macd)"""

_PAIR = "ret IS NOT NULL AND market IS NOT NULL"


def _beta(w: str) -> str:
    s = lambda e: f"sum(CASE WHEN {_PAIR} THEN {e} END) OVER {w}"
    n = f"count(CASE WHEN {_PAIR} THEN 1 END) OVER {w}"
    return f"({s('market * ret')} - {s('market')} * {s('ret')} / nullif({n}, 0)) / nullif({s('market * market')} - {s('market')} * {s('market')} / nullif({n}, 0), 0)"


_AI = "(PARTITION BY asset, indicator ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_DIR = lambda x, tau: f"CASE WHEN {x} > {tau} THEN 1 WHEN {x} < -{tau} THEN -1 ELSE 0 END"
PRIOR = f"""{NEWS_SQL}, bt AS (SELECT ticker, avg(raw_score) AS pt FROM news GROUP BY ticker), bg AS (SELECT group_key, avg(raw_score) AS pg FROM news GROUP BY group_key),
pr AS (SELECT *, round(coalesce(pt, pg, 0.0), 9) AS prior, coalesce(pt, pg) IS NOT NULL AS prior_found, raw_score - round(coalesce(pt, pg, 0.0), 9) AS s0 FROM news LEFT JOIN bt USING (ticker) LEFT JOIN bg USING (group_key))"""
PRICES = f"""{BARS_SQL}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT date FROM bars GROUP BY date HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM bars))),
pp AS (SELECT asset, date, t, adj_close AS price FROM bars JOIN cal USING (date))"""
SEGMENTS = f"""{PRICES}, s0 AS (SELECT asset, t AS t0, lead(t) OVER w AS t1, lead(price) OVER w / price AS g FROM pp WHERE t % 5 = 0 WINDOW w AS (PARTITION BY asset ORDER BY t)),
s1 AS (SELECT * FROM s0 WHERE t1 IS NOT NULL), tot AS (SELECT t0, t1, avg(g) AS m, count(*) AS n FROM s1 GROUP BY t0, t1),
dr AS (SELECT s1.t1 AS t0, sum(abs(1.0 / n - g / m / n)) AS turnover FROM s1 JOIN tot ON s1.t0 = tot.t0 GROUP BY s1.t1),
seg AS (SELECT tot.t0, t1, m - 1 AS gross, coalesce(turnover, 1.0) AS turnover FROM tot LEFT JOIN dr ON tot.t0 = dr.t0)"""
LIN = "(1 + gross) * (1 - turnover * {b} / 10000.0) - 1"
TRIP = "(gross * (1 - turnover * {b} / 20000.0) - 2 * turnover * {b} / 20000.0) / (1 + turnover * {b} / 20000.0)"
FORECAST = f"""{PRICES}, lr AS (SELECT asset, t, ln(price) - lag(ln(price)) OVER (PARTITION BY asset ORDER BY t) AS r FROM pp), ats AS (SELECT DISTINCT t AS t0 FROM pp WHERE t >= 60 AND t % 5 = 0 AND t <= (SELECT max(t) FROM pp) - 5),
fc AS (SELECT t0 AS t, asset, avg(r) AS mu, var_samp(r) AS v FROM ats JOIN lr ON lr.t > t0 - 60 AND lr.t <= t0 AND r IS NOT NULL GROUP BY t0, asset)"""
CHUNKS = r"""wd AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
nk AS (SELECT *, len(w) AS n, greatest(1, CAST(ceil(len(w) / 128) AS BIGINT)) AS k FROM wd), ix AS (SELECT *, unnest(range(k)) AS chunk FROM nk),
cut AS (SELECT doc_id, n, k, chunk, CASE WHEN n <= 128 THEN text ELSE array_to_string(w[128 * chunk + 1 : 128 * chunk + 128], ' ') END AS piece FROM ix)"""
EDGES = "v AS (SELECT label AS grp, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), ed AS (SELECT a.grp, a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS cosine FROM v a JOIN v b ON a.grp = b.grp AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.4)"
SERIES = f"""{MACRO_SQL}, sp AS (SELECT indicator, min(date) AS lo, max(date) AS hi FROM macro GROUP BY indicator HAVING count(*) >= 122), gr AS (SELECT indicator, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
x0 AS (SELECT indicator, date, last_value(adj_close IGNORE NULLS) OVER (PARTITION BY indicator ORDER BY date) AS x FROM gr LEFT JOIN macro USING (indicator, date)),
x1 AS (SELECT *, x / nullif(lag(x) OVER (PARTITION BY indicator ORDER BY date), 0) - 1 AS ret FROM x0),
series AS (SELECT indicator, date, x, ret, CASE WHEN count(ret) OVER w >= 30 THEN (ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0) END AS z FROM x1 WINDOW w AS (PARTITION BY indicator ORDER BY date ROWS 119 PRECEDING))"""

_ROUNDED = lambda names, k: ", ".join(f"round({c}, {k}) AS {c}" for c in names.split())

ORACLES: dict[str, str] = {
    "daily_features": f"WITH {BARS_SQL}, {FEATURES} SELECT asset, date, {_ROUNDED('ret_close ret_oc ret_overnight ret_adj hl_range vol_change mom_5 mom_20 roll_vol roll_mean_ret rel_volume rsi atr z_ret z_volume ma_ratio', 6)}, round(amihud, 12) AS amihud FROM features",
    "rolling_ols": f"WITH {BARS_SQL}, {RET}, {MARKET}, {OLS} SELECT asset, date, {_ROUNDED('beta alpha resid resid_r2', 5)} FROM olsn",
    "ewm_macd": f"WITH {BARS_SQL}, lp AS (SELECT asset, date, ln(adj_close) AS path FROM bars), {_macd('lp')} SELECT asset, date, {_ROUNDED('macd macd_signal hist', 6)} FROM macd",
    "ewm_long_series": f"""WITH RECURSIVE {NEWS_SQL}, s AS (SELECT article_id AS date, raw_score + article_id % 7 AS x, row_number() OVER (ORDER BY article_id) AS n FROM news),
      f AS (SELECT n, date, x AS a, x AS b, 0.0::DOUBLE AS g FROM s WHERE n = 1 UNION ALL
        SELECT s.n, s.date, f.a + (s.x - f.a) * 2 / 21.0::DOUBLE, f.b + (s.x - f.b) * 2 / 51.0::DOUBLE, CASE WHEN s.n <= 50 THEN (f.a + (s.x - f.a) * 2 / 21.0::DOUBLE) - (f.b + (s.x - f.b) * 2 / 51.0::DOUBLE) ELSE f.g + ((f.a + (s.x - f.a) * 2 / 21.0::DOUBLE) - (f.b + (s.x - f.b) * 2 / 51.0::DOUBLE) - f.g) * 2 / 16.0::DOUBLE END FROM f JOIN s ON s.n = f.n + 1)
      SELECT date, CASE WHEN n >= 50 THEN round(a - b, 7) END AS macd, CASE WHEN n >= 64 THEN round(g, 7) END AS macd_signal, CASE WHEN n >= 64 THEN round(a - b - g, 7) END AS hist FROM f""",
    "imacd": f"WITH {BARS_SQL}, {RET}, {MARKET}, {IMACD} SELECT asset, date, {_ROUNDED('imacd resid_r2', 4)} FROM im",
    "alpha_filter": f"""WITH {BARS_SQL}, {RET}, {MARKET}, {IMACD}, a0 AS (SELECT asset, date, round(imacd, 4) AS i, CASE WHEN round(imacd, 4) IS NULL OR round(resid_r2, 4) IS NULL OR round(resid_r2, 4) > 0.6 THEN 0 ELSE {_DIR('round(imacd, 4)', 0.5)} END AS d FROM im),
      a1 AS (SELECT *, CASE WHEN count(d) OVER {_w(3)} = 3 AND abs(sum(d) OVER {_w(3)}) >= 3 THEN d ELSE 0 END AS g FROM a0) SELECT asset, date, coalesce(abs(i), 0) AS strength, CASE WHEN g > 0 THEN 'BUY' WHEN g < 0 THEN 'SELL' ELSE 'HOLD' END AS signal FROM a1""",
    "alpha_filter_cross_sectional": f"""WITH {BARS_SQL}, {FEATURES}, q AS (SELECT asset, date, round(z_ret, 5) AS x FROM features), e AS (SELECT date, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi, count(x) AS n FROM q GROUP BY date)
      SELECT asset, date, CASE WHEN n >= 2 AND hi > lo AND x <= lo THEN -1 WHEN n >= 2 AND hi > lo AND x >= hi THEN 1 ELSE 0 END AS direction FROM q JOIN e USING (date)""",
    "signal_hold": f"WITH {BARS_SQL}, {FEATURES}, s AS (SELECT asset, date, {_DIR('round(z_ret, 5)', 1.5)} AS direction FROM features) SELECT asset, date, direction, coalesce(last_value(nullif(direction, 0) IGNORE NULLS) OVER {_w(5)}, 0) AS held FROM s",
    "persistence_gate": f"WITH {BARS_SQL}, {FEATURES}, s AS (SELECT asset, date, {_DIR('round(mom_5, 6)', 0.01)} AS d FROM features) SELECT asset, date, CASE WHEN count(d) OVER {_w(3)} = 3 AND abs(sum(d) OVER {_w(3)}) >= 3 THEN d ELSE 0 END AS kept FROM s",
    "rolling_beta": f"WITH {BARS_SQL}, {RET}, {MARKET} SELECT asset, date, CASE WHEN count(CASE WHEN {_PAIR} THEN 1 END) OVER {_w(60)} >= 30 THEN round({_beta(_w(60))}, 4) END AS beta FROM mk",
    "conditional_beta": f"""WITH {BARS_SQL}, {RET}, {MARKET}, up AS (SELECT asset, date, CASE WHEN count(CASE WHEN {_PAIR} THEN 1 END) OVER {_w(60)} >= 15 THEN {_beta(_w(60))} END AS b, count(*) OVER (PARTITION BY asset) AS c FROM mk WHERE market > 0)
      SELECT asset, date, round(last_value(CASE WHEN c >= 15 THEN b END IGNORE NULLS) OVER ({_A} ROWS UNBOUNDED PRECEDING), 4) AS cond_beta FROM mk LEFT JOIN up USING (asset, date)""",
    "forward_return": f"WITH {BARS_SQL} SELECT asset, date, round(ln(lead(adj_close, 5) OVER ({_A}) / adj_close), 8) AS target FROM bars",
    "splits_purged": f"""WITH {BARS_SQL}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM bars)),
      ll AS (SELECT *, CASE WHEN date >= DATE '1997-01-01' THEN 'test' WHEN t < round_even((SELECT count(*) FROM dd WHERE date < DATE '1997-01-01') * 0.8, 0) THEN 'train' ELSE 'val' END AS split FROM dd),
      pu AS (SELECT *, min(split) OVER w = max(split) OVER w AND count(*) OVER w = 6 AS ok FROM ll WINDOW w AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
      kept AS (SELECT *, min(t) OVER (PARTITION BY split) AS first FROM pu WHERE ok AND t >= 29) SELECT t, date, split FROM kept WHERE split = 'train' OR t >= first + 5""",
    "standardized_panel": f"""WITH {BARS_SQL}, {FEATURES}, st AS (SELECT avg(ret_adj) AS m1, stddev_pop(ret_adj) AS s1, avg(rsi) AS m2, stddev_pop(rsi) AS s2, avg(rel_volume) AS m3, stddev_pop(rel_volume) AS s3 FROM features WHERE date < DATE '1996-01-01')
      SELECT asset, date, round(coalesce((ret_adj - m1) / s1, 0), 5) AS ret_adj, round(coalesce((rsi - m2) / s2, 0), 5) AS rsi, round(coalesce((rel_volume - m3) / s3, 0), 5) AS rel_volume FROM features, st""",
    "macro_daily": f"WITH {SERIES} SELECT indicator, date, round(x, 4) AS x, round(ret, 5) AS ret, round(z, 5) AS z FROM series",
    "asof_ffill": f"WITH {BARS_SQL}, {MACRO_SQL}, pb AS (SELECT i.indicator, d.date FROM (SELECT DISTINCT indicator FROM macro) i, (SELECT DISTINCT date FROM bars) d) SELECT pb.indicator, pb.date, round(adj_close, 4) AS adj_close FROM pb ASOF LEFT JOIN macro ON pb.indicator = macro.indicator AND pb.date >= macro.date",
    "news_ingest_explode": r"""WITH r AS (SELECT doc_id, upper(source) AS sym, upper(lang) AS ty, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE strpos(text, chr(10)) END AS nl, text FROM documents),
      h AS (SELECT *, trim(CASE WHEN nl = 0 THEN text ELSE substr(text, 1, nl - 1) END) AS t, trim(CASE WHEN nl = 0 THEN '' ELSE substr(text, nl + 1) END) AS c FROM r),
      s AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN [sym, 'A', 'B'] WHEN 1 THEN [sym, 'A', 'B', 'C'] ELSE [sym] END AS tick FROM h WHERE t <> '' OR c <> '')
      SELECT CAST(doc_id AS VARCHAR) AS article_id, unnest(tick) AS ticker, 'EX' AS exchange, 'EX:' || ty AS group_key, CAST(length(t) + length(c) + CASE WHEN t <> '' AND c <> '' THEN 2 ELSE 0 END AS BIGINT) AS n_chars FROM s""",
    "news_ingest_whole": r"""WITH r AS (SELECT doc_id, upper(source) AS sym, upper(lang) AS ty, strpos(text, chr(10)) AS nl, text FROM documents),
      h AS (SELECT *, trim(CASE WHEN nl = 0 THEN text ELSE substr(text, 1, nl - 1) END) AS t, trim(CASE WHEN nl = 0 THEN '' ELSE substr(text, nl + 1) END) AS c FROM r),
      f AS (SELECT *, CASE WHEN c = '' THEN t WHEN t = '' THEN c ELSE t || '. ' || c END AS body, CASE doc_id % 4 WHEN 0 THEN [sym, 'A', 'B'] WHEN 1 THEN [sym, 'A', 'B', 'C'] ELSE [sym] END AS tick FROM h)
      SELECT CAST(doc_id AS VARCHAR) AS article_id, unnest(tick) AS ticker, 'EX' AS exchange, 'EX:' || ty AS group_key, CAST(length(body) AS BIGINT) AS n_chars, md5(body) AS text_md5 FROM f WHERE body <> ''""",
    "session_snap": """WITH ev AS (SELECT CAST(ts AS DATE) + CAST(CASE WHEN hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 > 20 THEN 1 ELSE 0 END AS INTEGER) AS day FROM events), se AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5)
      SELECT session, count(*) AS n FROM ev ASOF JOIN se ON ev.day <= se.session GROUP BY session""",
    "news_window_features": f"""WITH {NEWS_SQL}, a AS (SELECT group_key AS asset, raw_score AS s, CAST(valid_time AS DATE) + CAST(CASE WHEN hour(valid_time) + minute(valid_time) / 60.0 + second(valid_time) / 3600.0 > 20 THEN 1 ELSE 0 END AS INTEGER) AS day FROM news),
      d AS (SELECT DISTINCT event_type AS asset, CAST(ts AS DATE) AS date FROM events)
      SELECT d.asset, d.date, count(a.s) AS n_articles, round(coalesce(avg(a.s), 0), 8) AS mean_sentiment, round(ln(1 + count(a.s)), 8) AS log_n_articles FROM d LEFT JOIN a ON a.asset = d.asset AND a.day >= d.date - 7 AND a.day < d.date GROUP BY d.asset, d.date""",
    "trailing_median": f"""WITH {NEWS_SQL} SELECT a.article_id, round(coalesce(median(b.raw_score), 0), 8) AS location, count(b.raw_score) AS n_before FROM news a LEFT JOIN news b ON a.ticker = b.ticker AND b.valid_time < a.valid_time AND b.valid_time >= a.valid_time - INTERVAL 60 DAY GROUP BY a.article_id""",
    "entity_prior": f"WITH {PRIOR} SELECT article_id, round(prior, 6) AS prior, prior_found, round(s0, 6) AS s0 FROM pr",
    "neutralize": f"""WITH {PRIOR}, lt AS (SELECT a.article_id, coalesce(median(b.s0), 0) AS lt, count(b.s0) AS nt FROM pr a LEFT JOIN pr b ON a.ticker = b.ticker AND b.valid_time < a.valid_time AND b.valid_time >= a.valid_time - INTERVAL 60 DAY GROUP BY a.article_id),
      lg AS (SELECT a.article_id, coalesce(median(b.s0), 0) AS lg FROM pr a LEFT JOIN pr b ON a.group_key = b.group_key AND b.valid_time < a.valid_time AND b.valid_time >= a.valid_time - INTERVAL 60 DAY GROUP BY a.article_id),
      n1 AS (SELECT pr.*, nt / (nt + 20.0) AS w, s0 - (nt / (nt + 20.0) * lt + (1 - nt / (nt + 20.0)) * lg) AS s1 FROM pr JOIN lt USING (article_id) JOIN lg USING (article_id))
      SELECT article_id, ticker, round(w, 5) AS shrinkage_weight_w, round(CASE WHEN count(*) OVER g < 3 THEN s1 ELSE (s1 - avg(s1) OVER g) / greatest(stddev_pop(s1) OVER g, 0.000001) END, 5) AS sentiment_final, CASE WHEN count(*) OVER g < 3 THEN 'group_too_small' WHEN prior_found THEN 'ok' ELSE 'no_prior_available' END AS neutralization_status
      FROM n1 WINDOW g AS (PARTITION BY CAST(valid_time AS DATE), group_key)""",
    "cosine_edges": f"WITH {EDGES} SELECT grp, a, b, round(cosine, 5) AS cosine FROM ed",
    "story_components": f"WITH RECURSIVE {EDGES}, bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re AS (SELECT id, id AS r FROM v UNION SELECT re.id, bo.b FROM re JOIN bo ON re.r = bo.a) SELECT grp, v.id, min(r) AS component FROM v JOIN re ON v.id = re.id GROUP BY grp, v.id",
    "equal_weight_backtest": f"WITH {SEGMENTS} SELECT t0, t1, round(gross, 7) AS gross, round(turnover, 7) AS turnover, round({LIN.format(b=15)}, 7) AS net FROM seg",
    "cost_models": f"WITH {SEGMENTS} SELECT t0, " + ", ".join(f"round({LIN.format(b=b)}, 7) AS linear_{b}, round({TRIP.format(b=b)}, 7) AS round_trip_{b}" for b in (0, 15, 40)) + " FROM seg",
    "walk_forward": f"""WITH {SEGMENTS}, i AS (SELECT *, {LIN.format(b=15)} AS net, row_number() OVER (ORDER BY t0) - 1 AS i, count(*) OVER () AS n FROM seg), k AS (SELECT *, greatest(1, least(3, n)) AS k FROM i)
      SELECT ((i + 1) * k - 1) // n + 1 AS fold, min(t0) AS start, max(t1) AS "end", count(*) AS n_segments, round(exp(sum(ln(1 + net))) - 1, 6) AS net, round(avg(turnover), 6) AS avg_turnover FROM k GROUP BY fold""",
    "portfolio_metrics": f"""WITH {PRICES}, e AS (SELECT asset AS strategy, t, price / first_value(price) OVER (PARTITION BY asset ORDER BY t) AS value FROM pp),
      r AS (SELECT *, value / lag(value) OVER (PARTITION BY strategy ORDER BY t) - 1 AS r, value / max(value) OVER (PARTITION BY strategy ORDER BY t) - 1 AS dd FROM e),
      a AS (SELECT strategy, arg_max(value, t) AS last, count(r) AS n, stddev_samp(r) AS sd, avg(r) AS mean, stddev_pop(CASE WHEN r < 0 THEN r END) AS down, min(dd) AS mdd, avg(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0.0 END) AS hit FROM r GROUP BY strategy)
      SELECT strategy, round(last - 1, 4) AS cum_return_net, round(power(last, 252.0 / n) - 1, 4) AS annualized_return, round(sd * sqrt(252), 4) AS annualized_vol, round(mean / sd * sqrt(252), 4) AS sharpe, round((power(last, 252.0 / n) - 1) / nullif(down * sqrt(252), 0), 4) AS sortino,
      round(CASE WHEN mdd < 0 THEN (power(last, 252.0 / n) - 1) / abs(mdd) END, 4) AS calmar, round(mdd, 4) AS max_drawdown, round(hit, 4) AS hit_rate FROM a""",
    "covariance_forecast": f"WITH {FORECAST} SELECT t, asset, round(mu, 7) AS mu, round(v, 7) AS variance FROM fc",
    "lognormal_moments": f"WITH {FORECAST} SELECT t, asset, round(exp(mu + v / 2) - 1, 7) AS mean, round(exp(2 * mu + v) * (exp(v) - 1), 7) AS variance FROM fc",
    "mask_renormalized": f"""WITH {PRICES}, w AS (SELECT t, asset, CASE WHEN round(price, 4) > round(avg(price) OVER (PARTITION BY t), 4) THEN 1.0 / count(*) OVER (PARTITION BY t) ELSE 0.0 END AS k FROM pp WHERE t % 5 = 0)
      SELECT t, asset, round(CASE WHEN sum(k) OVER (PARTITION BY t) > 1e-12 THEN k / sum(k) OVER (PARTITION BY t) ELSE 0.0 END, 8) AS weight FROM w""",
    "event_windows": f"WITH {NEWS_SQL} SELECT group_key, date_trunc('day', valid_time) AS start, count(*) AS n, round(avg(raw_score), 8) AS mean FROM news GROUP BY ALL",
    "naive_buy_and_hold": f"WITH {PRICES}, f AS (SELECT asset, price AS p0 FROM pp WHERE t = 0) SELECT t, round(avg(price / p0), 7) AS value FROM pp JOIN f USING (asset) GROUP BY t",
    "naive_index": f"""WITH {PRICES}, {MACRO_SQL}, pb AS (SELECT i.indicator, d.date FROM (SELECT DISTINCT indicator FROM macro) i, (SELECT DISTINCT date FROM pp) d),
      al AS (SELECT pb.indicator, pb.date, adj_close FROM pb ASOF LEFT JOIN macro ON pb.indicator = macro.indicator AND pb.date >= macro.date),
      b0 AS (SELECT indicator, adj_close AS base FROM al WHERE date = (SELECT min(date) FROM al)) SELECT indicator, date, round(adj_close / base, 6) AS value FROM al JOIN b0 USING (indicator)""",
    "return_distribution": f"""WITH {BARS_SQL}, {RET}, st AS (SELECT asset, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM ret GROUP BY asset HAVING count(ret) >= 60 AND stddev_samp(ret) > 1e-12),
      z AS (SELECT asset, ret AS r, (ret - m) / s AS z FROM ret JOIN st USING (asset) WHERE ret IS NOT NULL), c AS (SELECT avg(z) AS mz FROM z)
      SELECT count(*) AS n, count(DISTINCT asset) AS n_assets, round(var_samp(r), 10) AS variance, round(avg((z - mz) ** 3) / avg((z - mz) ** 2) ** 1.5, 6) AS skew, round(kurtosis(z), 6) AS excess_kurtosis FROM z, c""",
    "text_chunks": f"WITH {CHUNKS} SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(k AS INT) AS n_chunks, md5(piece) AS piece_md5 FROM cut",
    "chunk_reduce": f"""WITH {CHUNKS}, m AS (SELECT doc_id, sum(len(list_distinct(w[128 * chunk + 1 : 128 * chunk + 128]))) AS words FROM ix GROUP BY doc_id)
      SELECT doc_id, CAST(greatest(1, ceil(words / 128)) AS INT) AS n_chunks, CAST(words AS BIGINT) AS n_words FROM m""",
    "macro_channel": f"""WITH {BARS_SQL}, {SERIES}, {RET}, {MARKET}, bd AS (SELECT DISTINCT date FROM bars), pb AS (SELECT i.indicator, bd.date FROM (SELECT DISTINCT indicator FROM series) i, bd),
      rs AS (SELECT indicator, date, ret FROM series WHERE ret IS NOT NULL), zs AS (SELECT indicator, date, z FROM series WHERE z IS NOT NULL),
      ar AS (SELECT pb.indicator, pb.date, rs.ret FROM pb ASOF LEFT JOIN rs ON pb.indicator = rs.indicator AND pb.date >= rs.date), az AS (SELECT pb.indicator, pb.date, zs.z FROM pb ASOF LEFT JOIN zs ON pb.indicator = zs.indicator AND pb.date >= zs.date),
      x AS (SELECT asset, date, indicator, ret.ret, ar.ret AS market, z FROM ret JOIN ar USING (date) JOIN az USING (indicator, date)),
      bt AS (SELECT *, CASE WHEN count(CASE WHEN {_PAIR} THEN 1 END) OVER {_AI} = 60 THEN {_beta(_AI)} END AS beta FROM x),
      up AS (SELECT asset, indicator, date, CASE WHEN count(*) OVER (PARTITION BY asset, indicator) >= 15 AND count(CASE WHEN {_PAIR} THEN 1 END) OVER {_AI} >= 15 THEN {_beta(_AI)} END AS u FROM x WHERE market > 0),
      dn AS (SELECT asset, indicator, date, CASE WHEN count(*) OVER (PARTITION BY asset, indicator) >= 15 AND count(CASE WHEN {_PAIR} THEN 1 END) OVER {_AI} >= 15 THEN {_beta(_AI)} END AS d FROM x WHERE market < 0),
      cb AS (SELECT bt.*, last_value(u IGNORE NULLS) OVER w AS u, last_value(d IGNORE NULLS) OVER w AS d FROM bt LEFT JOIN up USING (asset, indicator, date) LEFT JOIN dn USING (asset, indicator, date) WINDOW w AS (PARTITION BY asset, indicator ORDER BY date ROWS UNBOUNDED PRECEDING)),
      ct AS (SELECT asset, date, sum(CASE WHEN hit AND z > 0 THEN 1 ELSE 0 END) AS n_pos, sum(CASE WHEN hit AND z <= 0 THEN 1 ELSE 0 END) AS n_neg, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS n_trigger FROM (SELECT *, coalesce(abs(z) >= 1 AND abs(beta) > 0 AND abs(CASE WHEN z > 0 THEN u ELSE d END) >= 0, false) AS hit FROM cb) GROUP BY asset, date),
      {FEATURES}, ow AS (SELECT asset, date, {_DIR('round(z_ret, 5)', 1.0)} AS own FROM features), g AS (SELECT *, CASE WHEN n_trigger > 0 AND n_pos = n_trigger THEN 1 WHEN n_trigger > 0 AND n_neg = n_trigger THEN -1 ELSE 0 END AS direction FROM ct JOIN ow USING (asset, date))
      SELECT asset, date, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, n_trigger::BIGINT AS n_trigger, direction, CASE WHEN own <> 0 AND direction = 0 THEN own ELSE 0 END AS alpha, CASE WHEN direction <> 0 AND own = 0 THEN direction ELSE 0 END AS beta, CASE WHEN own <> 0 AND own = direction THEN own ELSE 0 END AS "both" FROM g""",
    "story_representatives": f"""WITH RECURSIVE {EDGES}, bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re AS (SELECT id, id AS r FROM v UNION SELECT re.id, bo.b FROM re JOIN bo ON re.r = bo.a), cp AS (SELECT grp, v.id, e, min(r) AS component FROM v JOIN re ON v.id = re.id GROUP BY grp, v.id, e),
      nr AS (SELECT x.grp, x.component, x.id, count(*) AS size, round(sum(list_cosine_similarity(x.e, y.e)) / any_value(nm), 9) AS near FROM cp x JOIN cp y ON x.grp = y.grp AND x.component = y.component JOIN (SELECT p.grp, p.component, sqrt(sum(list_cosine_similarity(p.e, q.e))) AS nm FROM cp p JOIN cp q ON p.grp = q.grp AND p.component = q.component GROUP BY ALL) n ON n.grp = x.grp AND n.component = x.component GROUP BY ALL)
      SELECT grp, component, id, size FROM nr QUALIFY row_number() OVER (PARTITION BY grp, component ORDER BY near DESC, id) = 1""",
    "rolling_quantile_bars": f"WITH {BARS_SQL} SELECT asset, date, CASE WHEN count(close) OVER {_w(20)} = 20 THEN round(quantile_cont(close, 0.5) OVER {_w(20)}, 7) END AS median_close FROM bars",
}
