"""The queries' SQL for DuckDB, written as chains of common table expressions."""

from __future__ import annotations


def q(x: str, name: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6 AS {name}"


DAILY = """p AS (SELECT l_suppkey::VARCHAR AS symbol, l_shipdate::TIMESTAMP AS ts, l_extendedprice / l_quantity AS price, l_quantity,
    {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey} AS k FROM lineitem),
bars AS (SELECT symbol, ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume, 'rth' AS session FROM p GROUP BY symbol, ts)"""


def events(minutes: int) -> str:
    return f"""p AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts::TIMESTAMP) AS b, value AS price, {{'a': ts, 'b': event_id}} AS k FROM events),
o AS (SELECT symbol, b AS ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, count(*)::DOUBLE AS volume FROM p GROUP BY symbol, b),
z AS (SELECT *, ts - INTERVAL '5 hours' AS et FROM o),
bars AS (SELECT symbol, ts, open, high, low, close, volume, CASE WHEN hour(et) * 60 + minute(et) < 570 THEN 'pre' WHEN hour(et) * 60 + minute(et) < 960 THEN 'rth' ELSE 'post' END AS session FROM z)"""


W = "PARTITION BY symbol ORDER BY ts"
BARS = ", ".join(["symbol", "ts", "session", *(q(c, c) for c in ("open", "high", "low", "close", "volume"))])


def over(f: str, x: str, n: int) -> str:
    r = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {r} = {n} THEN {f} {r} END"


def rank(x: str, n: int) -> str:
    earlier = f"list({x}) FILTER ({x} IS NOT NULL) OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN len({earlier}) = {n} AND {x} IS NOT NULL THEN len(list_filter({earlier}, lambda v: v <= {x})) * 100.0::DOUBLE / {n} END"


def recursion(source: str, column: str, out: str, n: int, alpha: str) -> str:
    """CTEs that end in {source}_{out}: symbol, ts, out."""
    x = f"{source}_{out}"
    return f"""{x}_v AS (SELECT symbol, ts, {column} AS x, row_number() OVER ({W}) AS rn FROM {source} WHERE {column} IS NOT NULL),
{x}_s AS (SELECT symbol, avg(x) AS y FROM {x}_v WHERE rn <= {n} GROUP BY symbol HAVING count(*) = {n}),
{x}_r AS (SELECT symbol, {n}::BIGINT AS rn, y FROM {x}_s UNION ALL SELECT v.symbol, v.rn, {alpha} * v.x + (1 - {alpha}) * r.y FROM {x}_r r JOIN {x}_v v ON v.symbol = r.symbol AND v.rn = r.rn + 1),
{x} AS (SELECT v.symbol, v.ts, r.y AS {out} FROM {x}_v v JOIN {x}_r r ON v.symbol = r.symbol AND v.rn = r.rn)"""


def ema(source: str, column: str, out: str, n: int) -> str:
    return recursion(source, column, out, n, f"(2.0::DOUBLE / {n + 1})")


def rma(source: str, column: str, out: str, n: int) -> str:
    return recursion(source, column, out, n, f"(1.0::DOUBLE / {n})")


def joined(name: str, source: str, *outs: str) -> str:
    return f"{name} AS (SELECT {source}.*, {', '.join(outs)} FROM {source} " + " ".join(f"LEFT JOIN {source}_{o} USING (symbol, ts)" for o in outs) + ")"


RECURSIVE = "WITH RECURSIVE "
CROSS_UP = "coalesce({a} > {b} AND lag({a}) OVER (" + W + ") <= lag({b}) OVER (" + W + "), false)"
CROSS_DN = "coalesce({a} < {b} AND lag({a}) OVER (" + W + ") >= lag({b}) OVER (" + W + "), false)"


def cross(a: str, b: str, up: bool) -> str:
    text = (CROSS_UP if up else CROSS_DN).replace("{a}", a)
    return text.replace("lag({b}) OVER (" + W + ")", b if b.lstrip("-").replace(".", "").isdigit() else "lag({b}) OVER (" + W + ")").replace("{b}", b)


def since(c: str) -> str:
    return f"rn - last_value(CASE WHEN {c} THEN rn END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


TR = f"greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W})))"
CHANGE = f"d AS (SELECT *, {TR} AS tr, close - lag(close) OVER ({W}) AS d FROM bars),\ng AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss FROM d)"
RSI = "CASE WHEN down = 0 THEN 100.0::DOUBLE WHEN down IS NOT NULL THEN 100.0 - 100.0 / (1.0 + up / nullif(down, 0)) END"


def momentum(source: str, position: bool = False, fresh: bool = False) -> str:
    """CTEs that end in mb."""
    if position:
        m = f"m AS (SELECT *, close - {over('avg(close)', 'close', 50)} AS m, {over('stddev_pop(close)', 'close', 50)} AS nrm FROM {source})"
    else:
        m = f"m0 AS (SELECT *, close - lag(close, 10) OVER ({W}) AS m FROM {source}),\nm AS (SELECT *, {over('avg(abs(m))', 'm', 50)} AS nrm FROM m0)"
    own = "OVER (PARTITION BY symbol, session = 'rth' ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    up, dn = "surge AND mb_state > 0", "surge AND mb_state < 0"
    star = f"CASE WHEN ({up}) THEN 1 WHEN ({dn}) THEN -1 ELSE 0 END" if not fresh else f"CASE WHEN up AND NOT coalesce(lag(up) OVER ({W}), false) THEN 1 WHEN dn AND NOT coalesce(lag(dn) OVER ({W}), false) THEN -1 ELSE 0 END"
    return f"""{m},
n AS (SELECT *, CASE WHEN nrm > 0 THEN m / nrm ELSE 0.0 END AS mb_raw, CASE WHEN session = 'rth' AND count(volume) {own} = 20 THEN avg(volume) {own} END AS a FROM m),
n1 AS (SELECT *, 50.0 * tanh(mb_raw / 2.0) AS s, last_value(a IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS av FROM n),
{ema("n1", "s", "mb_score", 3)},
{joined("n2", "n1", "mb_score")},
n3 AS (SELECT *, CASE WHEN mb_score >= 30 THEN 2 WHEN mb_score > 5 THEN 1 WHEN mb_score <= -30 THEN -2 WHEN mb_score < -5 THEN -1 ELSE 0 END AS mb_state,
  CASE WHEN av > 0 THEN volume / av END AS mb_rvol FROM n2),
n4 AS (SELECT *, session = 'rth' AND coalesce(mb_rvol >= 2, false) AS surge FROM n3),
n5 AS (SELECT *, {up} AS up, {dn} AS dn FROM n4),
mb AS (SELECT *, abs(mb_score) / 50.0 * 100.0 AS mb_strength_pct, {star} AS mb_star, {cross('mb_score', '0', True)} AS mb_cross_zero_up, {cross('mb_score', '0', False)} AS mb_cross_zero_dn,
  {cross('mb_score', '30', True)} AS mb_cross_strong_up, {cross('mb_score', '-30', False)} AS mb_cross_strong_dn FROM n5)"""


MB = "SELECT symbol, ts, mb_state, mb_star, mb_cross_zero_up, mb_cross_zero_dn, mb_cross_strong_up, mb_cross_strong_dn, " + ", ".join(q(c, c) for c in ("mb_score", "mb_strength_pct", "mb_raw", "mb_rvol")) + " FROM mb"


def regime(htf: bool = False) -> str:
    """CTEs that end in ggr."""
    if htf:
        head = f"""{CHANGE},
h0 AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01 14:30:00') AS b, ts AS t, close FROM bars),
h1 AS (SELECT symbol, b AS ts, arg_max(close, t) AS close FROM h0 GROUP BY symbol, b),
h2 AS (SELECT *, close - lag(close) OVER ({W}) AS d FROM h1),
h3 AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss FROM h2),
{rma("h3", "gain", "up", 14)},
{rma("h3", "loss", "down", 14)},
{joined("h4", "h3", "up", "down")},
h5 AS (SELECT *, {RSI} AS ggr_rsi FROM h4),
h6 AS (SELECT symbol, ts AS b, ggr_rsi, {over('avg(ggr_rsi)', 'ggr_rsi', 20)} AS ggr_rsi_basis, {over('stddev_pop(ggr_rsi)', 'ggr_rsi', 20)} AS dev FROM h5),
h7 AS (SELECT symbol, b, lag(ggr_rsi) OVER v AS ggr_rsi, lag(ggr_rsi_basis) OVER v AS ggr_rsi_basis, lag(dev) OVER v AS dev FROM h6 WINDOW v AS (PARTITION BY symbol ORDER BY b)),
{rma("g", "tr", "atr", 14)},
{joined("r1", "g", "atr")},
r2 AS (SELECT r1.*, ggr_rsi, ggr_rsi_basis, dev FROM r1 LEFT JOIN h7 ON h7.symbol = r1.symbol AND h7.b = time_bucket(INTERVAL '1 hour', r1.ts, TIMESTAMP '2024-01-01 14:30:00'))"""
    else:
        head = f"""{CHANGE},
{rma("g", "tr", "atr", 14)},
{rma("g", "gain", "up", 14)},
{rma("g", "loss", "down", 14)},
{joined("r0", "g", "atr", "up", "down")},
r1 AS (SELECT *, {RSI} AS ggr_rsi FROM r0),
r2 AS (SELECT *, {over('avg(ggr_rsi)', 'ggr_rsi', 20)} AS ggr_rsi_basis, {over('stddev_pop(ggr_rsi)', 'ggr_rsi', 20)} AS dev FROM r1)"""
    return f"""{head},
r3 AS (SELECT *, {over('avg(close)', 'close', 8)} AS fast, {over('avg(close)', 'close', 20)} AS slow,
  CASE WHEN dev IS NOT NULL THEN least(100, ggr_rsi_basis + dev) END AS hi, CASE WHEN dev IS NOT NULL THEN greatest(0, ggr_rsi_basis - dev) END AS lo FROM r2),
r4 AS (SELECT *, CASE WHEN fast > slow THEN 1 WHEN fast < slow THEN -1 ELSE 0 END AS ma, CASE WHEN ggr_rsi > ggr_rsi_basis THEN 1 WHEN ggr_rsi < ggr_rsi_basis THEN -1 ELSE 0 END AS rs,
  CASE WHEN ggr_rsi > hi THEN 1 WHEN ggr_rsi < lo THEN -1 ELSE 0 END AS ggr_thrust, CASE WHEN atr > 0 THEN (fast - slow) / atr END AS ggr_width_atr, hi - lo AS ggr_rsi_band_width FROM r3),
r5 AS (SELECT *, ma <> 0 AND coalesce(abs(ggr_width_atr) >= 0.5, false) AS dir FROM r4),
r6 AS (SELECT *, ma * CASE WHEN dir AND ggr_thrust = ma THEN 3 WHEN dir AND rs = ma THEN 2 WHEN dir THEN 1 ELSE 0 END AS ggr_state, row_number() OVER ({W}) AS rn,
  {cross('fast', 'slow', True)} AS ggr_cross_up, {cross('fast', 'slow', False)} AS ggr_cross_dn FROM r5),
r7 AS (SELECT *, coalesce(sign(ggr_state) <> lag(sign(ggr_state)) OVER ({W}), true) AS flip, lag(ggr_state, 1, 0) OVER ({W}) AS was FROM r6),
ggr AS (SELECT *, {since('flip')} AS ggr_bars_since_flip, (ma = rs)::INT AS ggr_ma_rsi_agree, ggr_state >= 2 AND was < 2 AS ggr_strong_up_enter, ggr_state <= -2 AND was > -2 AS ggr_strong_dn_enter,
  ggr_state = 3 AND was <> 3 AS ggr_thrust_up_enter, ggr_state = -3 AND was <> -3 AS ggr_thrust_dn_enter FROM r7)"""


GGR = "SELECT symbol, ts, ggr_state, ggr_thrust, ggr_ma_rsi_agree, ggr_bars_since_flip, ggr_cross_up, ggr_cross_dn, ggr_strong_up_enter, ggr_strong_dn_enter, ggr_thrust_up_enter, ggr_thrust_dn_enter, " + ", ".join(q(c, c) for c in ("ggr_rsi", "ggr_rsi_basis", "ggr_width_atr", "ggr_rsi_band_width")) + " FROM ggr"


def flow(source: str, zscore: bool = False, soft: bool = True, scale: str = "share", directional: bool = False, twice: bool = False, edges: bool = True) -> str:
    """CTEs that end in sf."""
    lo, hi = (0.0, 1.0) if zscore else (50.0, 75.0)
    gate = f"CASE WHEN sd > 0 THEN (dv - mu) / sd ELSE 0.0 END" if zscore else "pct"
    iw = f"CASE WHEN gate IS NOT NULL THEN greatest(0.0, least(1.0, (gate - {lo}) / {hi - lo})) END" if soft else f"CASE WHEN gate >= {hi} THEN 1.0 ELSE 0.0 END"
    rw = "1.0 - iw" if soft else f"CASE WHEN gate <= {lo} THEN 1.0 ELSE 0.0 END"
    toward = "(clv + 1.0) / 2.0" if directional else "1.0"
    s = lambda x, n: over(f"sum({x})", f"({x})", n)
    sums = ", ".join(f"{s(f'dv * {a}w * {toward}', 13)} AS {a}_raw, {s(f'dv * {a}w', 13)} AS {a}_gross, {s(f'dv * {a}w * clv', 13)} AS {a}_net, {s(f'dv * {a}w', 8)} AS {a}_fg, {s(f'dv * {a}w * clv', 8)} AS {a}_fn" for a in "ir")
    ratio = lambda n, d, f: f"CASE WHEN {d} > 0 THEN {n} / {d} ELSE {f} END"
    x = {
        "share": (ratio("100.0 * r_raw", "(i_raw + r_raw)", "50.0"), "100.0 - " + ratio("100.0 * r_raw", "(i_raw + r_raw)", "50.0")),
        "signed": ("r_signed", "i_signed"),
        "independent": (rank("r_raw", 100), rank("i_raw", 100)),
    }[scale]
    if twice:
        lines = f"{ema('f5', 'rx', 'r1', 5)},\n{ema('f5', 'ix', 'i1', 5)},\n{joined('f5b', 'f5', 'r1', 'i1')},\n{ema('f5b', 'r1', 'sf_retail', 5)},\n{ema('f5b', 'i1', 'sf_inst', 5)}"
        base = "f5b"
    else:
        lines, base = f"{ema('f5', 'rx', 'sf_retail', 5)},\n{ema('f5', 'ix', 'sf_inst', 5)}", "f5"
    edge = (lambda c: f"{c} AND NOT coalesce(lag({c}) OVER ({W}), false)") if edges else (lambda c: c)
    return f"""f0 AS (SELECT *, volume * ((high + low + close) / 3) AS dv, coalesce(lag(close) OVER ({W}), close) AS pc FROM {source}),
f1 AS (SELECT *, {rank('dv', 100)} AS pct, {over('avg(dv)', 'dv', 100)} AS mu, {over('stddev_pop(dv)', 'dv', 100)} AS sd, greatest(high, pc) AS ht, least(low, pc) AS lt FROM f0),
f2 AS (SELECT *, {gate} AS gate, CASE WHEN ht - lt > 0 THEN ((close - lt) - (ht - close)) / (ht - lt) ELSE 0.0 END AS clv FROM f1),
f2b AS (SELECT *, {iw} AS iw FROM f2),
f3 AS (SELECT *, {rw} AS rw FROM f2b),
f4 AS (SELECT *, {sums}, {over('quantile_cont(pct, 0.5)', 'pct', 8)} AS sf_tape_pct, close - lag(close, 8) OVER ({W}) AS move FROM f3),
f4b AS (SELECT *, {ratio('100.0 * r_net', 'r_gross', '0.0')} AS r_signed, {ratio('100.0 * i_net', 'i_gross', '0.0')} AS i_signed, {ratio('i_fn', 'i_fg', '0.0')} AS sf_inst_bias, {ratio('r_fn', 'r_fg', '0.0')} AS sf_retail_bias, i_net AS sf_inst_net_usd FROM f4),
f5 AS (SELECT *, {x[0]} AS rx, {x[1]} AS ix FROM f4b),
{lines},
{ema(base, 'i_signed', 'sf_inst_flow', 5)},
{ema(base, 'r_signed', 'sf_retail_flow', 5)},
{joined('f6', base, 'sf_retail', 'sf_inst', 'sf_inst_flow', 'sf_retail_flow')},
f7 AS (SELECT *, row_number() OVER ({W}) AS rn, coalesce(sf_tape_pct <= 40, false) AS quiet, coalesce(sf_tape_pct >= 60, false) AS active,
  {cross('sf_retail', 'sf_inst', True)} AS ov, {cross('sf_retail', 'sf_inst', False)} AS un FROM f6),
f8 AS (SELECT *, coalesce(move < 0, false) AND quiet AND sf_inst_bias >= 0.25 AS c1, coalesce(move > 0, false) AND quiet AND sf_inst_bias <= -0.25 AS c2,
  sf_inst_bias >= 0.25 AND sf_retail_bias >= 0.25 AND active AS c3, sf_inst_bias <= -0.25 AND sf_retail_bias <= -0.25 AND active AS c4 FROM f7),
sf AS (SELECT *, CASE WHEN sf_retail > sf_inst THEN 1 WHEN sf_retail < sf_inst THEN -1 ELSE 0 END AS sf_regime, CASE WHEN ov THEN 1 WHEN un THEN -1 ELSE 0 END AS sf_flip,
  coalesce({since('(ov OR un)')}, 0) AS sf_bars_since_flip, {edge('c1')} AS sf_accum, {edge('c2')} AS sf_dist, CASE WHEN {edge('c3')} THEN 1 WHEN {edge('c4')} THEN -1 ELSE 0 END AS sf_confluence FROM f8)"""


SF = "SELECT symbol, ts, sf_regime, sf_flip, sf_bars_since_flip, sf_accum, sf_dist, sf_confluence, " + ", ".join(q(c, c) for c in ("sf_retail", "sf_inst", "sf_inst_bias", "sf_retail_bias", "sf_inst_net_usd", "sf_inst_flow", "sf_retail_flow", "sf_tape_pct")) + " FROM sf"

BASE = f"""e0 AS (SELECT *, ts - INTERVAL '5 hours' AS et, lag(close) OVER ({W}) AS pc, avg(close) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS mean50, max(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM tailed),
base AS (SELECT symbol, close AS last_price, coalesce((close / pc - 1) * 100, 0.0) AS pct_chg, coalesce((close / pc - 1) * 100, 0.0) AS day_chg, close > mean50 AS above_sma50, close >= top AS new_high, ts AS last_bar FROM e0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"""
TAIL = "tailed AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 300)"
LAST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"


def scan() -> str:
    r = regime().replace("FROM bars", "FROM tailed")
    return f"""{RECURSIVE}{DAILY},
{TAIL},
{BASE},
{momentum('tailed')},
{r},
{flow('tailed')},
enough AS (SELECT symbol FROM tailed GROUP BY symbol HAVING count(*) >= 118),
rows0 AS (SELECT b.*, m.mb_score, m.mb_state, g.ggr_state, s.sf_inst_bias, s.sf_regime, s.sf_inst_net_usd,
  round_even(((least(100.0, greatest(0.0, 50.0 + m.mb_score))) + (g.ggr_state + 3) / 6.0 * 100.0 + least(100.0, greatest(0.0, (s.sf_inst_bias + 1.0) / 2.0 * 100.0))) / 3.0, 1) AS composite
  FROM base b JOIN enough USING (symbol) JOIN (SELECT * FROM mb {LAST}) m USING (symbol) JOIN (SELECT * FROM ggr {LAST}) g USING (symbol) JOIN (SELECT * FROM sf {LAST}) s USING (symbol)),
rows AS (SELECT *, CASE WHEN composite >= 80 THEN 'Strong Buy' WHEN composite >= 68 THEN 'Buy' WHEN composite >= 50 THEN 'Watch' WHEN composite >= 45 THEN 'Neutral' WHEN composite IS NOT NULL THEN 'Avoid' END AS signal FROM rows0)"""


def simple(source: str, *columns: str) -> str:
    return f"WITH {source} SELECT symbol, ts, {', '.join(columns)} FROM bars"


WATCH = "watch AS (SELECT s_suppkey::VARCHAR AS symbol FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'NONE')"

ORACLE = {
    "bars_daily": f"WITH {DAILY} SELECT {BARS} FROM bars",
    "bars_hourly": f"WITH {events(60)} SELECT {BARS} FROM bars",
    "session_counts": f"WITH {events(15)} SELECT symbol, session, count(*) AS n FROM bars GROUP BY symbol, session",
    "dedup_keep_last": f"SELECT user_id, event_type, ts, event_id, {q('value', 'value')} FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "tail_n": f"WITH {DAILY} SELECT {BARS} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 30",
    "drop_incomplete": f"WITH {events(60)}, c AS (SELECT * FROM bars WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'), l AS (SELECT *, lead(ts) OVER ({W}) IS NULL AS last FROM c) SELECT {BARS} FROM l WHERE NOT (last AND ts + INTERVAL '1 hour' > TIMESTAMP '2024-01-20 12:00:00')",
    "sma": simple(DAILY, q(over("avg(close)", "close", 8), "sma8"), q(over("avg(close)", "close", 20), "sma20")),
    "stdev_pop": simple(DAILY, q(over("stddev_pop(close)", "close", 20), "sd20")),
    "rolling_sum": simple(DAILY, q(over("sum(close)", "close", 13), "sum13")),
    "rolling_median": simple(DAILY, q(over("quantile_cont(close, 0.5)", "close", 9), "med9")),
    "highest_lowest": simple(DAILY, q(over("max(close)", "close", 10), "hi10"), q(over("min(close)", "close", 10), "lo10")),
    "change": simple(DAILY, q(f"close - lag(close) OVER ({W})", "chg1"), q(f"close - lag(close, 10) OVER ({W})", "mom10")),
    "percentrank": simple(DAILY, q(rank("close", 50), "pr")),
    "ema": f"{RECURSIVE}{DAILY}, {ema('bars', 'close', 'ema12', 12)}, {joined('o', 'bars', 'ema12')} SELECT symbol, ts, {q('ema12', 'ema12')} FROM o",
    "rma": f"{RECURSIVE}{DAILY}, {rma('bars', 'close', 'rma14', 14)}, {joined('o', 'bars', 'rma14')} SELECT symbol, ts, {q('rma14', 'rma14')} FROM o",
    "rsi": f"{RECURSIVE}{DAILY}, {CHANGE}, {rma('g', 'gain', 'up', 14)}, {rma('g', 'loss', 'down', 14)}, {joined('o', 'g', 'up', 'down')} SELECT symbol, ts, {q(RSI, 'rsi14')} FROM o",
    "atr": f"{RECURSIVE}{DAILY}, {CHANGE}, {rma('g', 'tr', 'atr14', 14)}, {joined('o', 'g', 'atr14')} SELECT symbol, ts, {q('atr14', 'atr14')} FROM o",
    "crosses": f"""WITH {DAILY}, a AS (SELECT *, {over('avg(close)', 'close', 8)} AS f, {over('avg(close)', 'close', 20)} AS s, row_number() OVER ({W}) AS rn FROM bars),
b AS (SELECT *, {cross('f', 's', True)} AS up, {cross('f', 's', False)} AS down, coalesce(f > s, false) AS hi FROM a)
SELECT symbol, ts, up, down, {since('up')} AS since, hi AND NOT coalesce(lag(hi) OVER ({W}), false) AS edge,
{q(f"last_value(CASE WHEN up THEN close END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 'last_up')} FROM b""",
    "momentum_velocity": f"{RECURSIVE}{DAILY}, {momentum('bars')} {MB}",
    "momentum_position": f"{RECURSIVE}{events(60)}, {momentum('bars', True, True)} {MB}",
    "regime_default": f"{RECURSIVE}{DAILY}, {regime()} {GGR}",
    "regime_htf": f"{RECURSIVE}{events(15)}, {regime(True)} {GGR}",
    "flow_share": f"{RECURSIVE}{DAILY}, {flow('bars')} {SF}",
    "flow_signed_zscore": f"{RECURSIVE}{DAILY}, {flow('bars', zscore=True, scale='signed', directional=True, twice=True)} {SF}",
    "flow_independent_hard": f"{RECURSIVE}{DAILY}, {flow('bars', soft=False, scale='independent', edges=False)} {SF}",
    "resample_ohlcv": f"""WITH {events(60)} SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS bucket, {q('arg_min(open, ts)', 'open')}, {q('max(high)', 'high')}, {q('min(low)', 'low')}, {q('arg_max(close, ts)', 'close')}, {q('sum(volume)', 'volume')},
CASE WHEN bool_or(session = 'rth') THEN 'rth' ELSE arg_min(session, ts) END AS session FROM bars GROUP BY 1, 2""",
    "htf_closed_value": f"""WITH {events(60)}, h AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS b, arg_max(close, ts) AS c, sum(volume) AS v FROM bars GROUP BY 1, 2),
l AS (SELECT symbol, b, lead(b) OVER w AS nb, c, v FROM h WINDOW w AS (PARTITION BY symbol ORDER BY b))
SELECT bars.symbol, bars.ts, {q('c', 'htf_close')}, {q('v', 'htf_volume')} FROM bars LEFT JOIN l ON l.symbol = bars.symbol AND l.nb = time_bucket(INTERVAL '4 hours', bars.ts)""",
    "scan_snapshot": f"{scan()} SELECT symbol, above_sma50, new_high, last_bar, mb_state, ggr_state, sf_regime, signal, {', '.join(q(c, c) for c in ('last_price', 'pct_chg', 'day_chg', 'mb_score', 'sf_inst_bias', 'composite'))} FROM rows",
    "scan_filter_topk": f"{scan()} SELECT symbol, {q('composite', 'composite')}, signal, {q('mb_score', 'mb_score')}, ggr_state FROM rows WHERE mb_score > -20 AND (ggr_state >= 0 OR above_sma50) AND NOT coalesce(pct_chg > 60, false) ORDER BY rows.composite DESC NULLS LAST, symbol LIMIT 20",
    "overview": f"""{scan()}, a AS (SELECT count(*) AS universe, count(*) FILTER (day_chg > 0) AS advancers, count(*) FILTER (day_chg < 0) AS decliners, count(*) FILTER (new_high) AS new_highs,
{q("avg(coalesce(above_sma50, false)::INT) * 100", 'above_sma50_pct')}, avg(coalesce(ggr_state > 0, false)::INT) * 100 AS pb, avg(coalesce(ggr_state < 0, false)::INT) * 100 AS ps,
{q("median(least(100.0, greatest(0.0, 50.0 + mb_score)))", 'iron')}, {q("avg(coalesce(mb_score > 0, false)::INT) * 100", 'pct_positive')}, {q("sum(coalesce(sf_inst_net_usd, 0))", 'silver_net')}, {q("avg(coalesce(sf_inst_bias > 0, false)::INT) * 100", 'pct_inflow')} FROM rows)
SELECT * EXCLUDE (pb, ps), {q('pb', 'pct_bull')}, {q('ps', 'pct_bear')}, CASE WHEN pb >= 55 THEN 'RISK-ON' WHEN ps >= 55 THEN 'RISK-OFF' ELSE 'NEUTRAL' END AS regime FROM a""",
    "top_signals": f"{scan()} SELECT symbol, {q('day_chg', 'day_chg')}, {q('composite', 'composite')}, signal, mb_state, ggr_state, sf_regime FROM rows ORDER BY rows.composite DESC NULLS LAST, symbol LIMIT 5",
    "missing_symbols": f"WITH {DAILY}, {WATCH} SELECT symbol, 'no data returned' AS error FROM watch WHERE symbol NOT IN (SELECT symbol FROM bars)",
    "starred_lookup": f"WITH {DAILY}, {WATCH}, l AS (SELECT symbol, close, lag(close) OVER ({W}) AS pc, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) SELECT watch.symbol, {q('close', 'last_price')}, {q('coalesce((close / pc - 1) * 100, CASE WHEN close IS NOT NULL THEN 0.0 END)', 'day_chg')} FROM watch LEFT JOIN l ON l.symbol = watch.symbol AND r = 1",
    "tape": f"WITH {DAILY}, l AS (SELECT symbol, close, coalesce(lag(close) OVER ({W}), close) AS pc, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) SELECT symbol, s_name AS label, {q('close', 'last')}, {q('CASE WHEN pc <> 0 THEN (close / pc - 1) * 100 ELSE 0.0 END', 'chg_pct')} FROM l JOIN supplier ON s_suppkey::VARCHAR = symbol WHERE r = 1",
    "short_history": "WITH u AS (SELECT DISTINCT user_id::VARCHAR AS symbol, date_trunc('hour', ts) AS ts FROM events), n AS (SELECT symbol, count(*) AS n FROM u GROUP BY symbol HAVING count(*) < 118) SELECT symbol, 'only ' || n || ' bars, 118 are needed' AS error FROM n",
}

#: Scripts say the same as the native queries.
ORACLE |= {f"script_{k}": ORACLE[k] for k in ("sma", "stdev_pop", "rolling_sum", "rolling_median", "highest_lowest", "change", "percentrank", "ema", "rma", "rsi", "atr", "crosses")}

FULL = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BASE_ROWS = f"""{DAILY}, b0 AS (SELECT *, lag(close) OVER ({W}) AS pc, avg(close) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS m, max(close) OVER ({W} {FULL}) AS h,
  row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars),
b1 AS (SELECT symbol, close AS last_price, coalesce((close / pc - 1) * 100.0, 0.0) AS pct_chg, coalesce((close / pc - 1) * 100.0, 0.0) AS day_chg, close > m AS above_sma50, close >= h AS new_high FROM b0 WHERE r = 1)"""


def first_close(last: int) -> str:
    """Bars of each symbol, and the close of the first of its last ones."""
    return f"""c AS (SELECT symbol, count(*) AS n, max(ts) AS newest, arg_min(close, ts) FILTER (r <= {last}) AS first_close
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) GROUP BY symbol)"""


ORACLE |= {
    "rth_only": f"WITH {events(60)} SELECT {BARS} FROM bars WHERE session = 'rth'",
    "trim_delay": f"WITH {events(15)} SELECT {BARS} FROM bars WHERE ts + INTERVAL '15 minutes' <= TIMESTAMP '2024-01-20 11:45:00'",
    "filter_operators": f"""WITH {BASE_ROWS} SELECT symbol, above_sma50, new_high, {', '.join(q(c, c) for c in ('last_price', 'pct_chg', 'day_chg'))} FROM b1
WHERE ((last_price * 2 - 1 >= 3000 OR pct_chg ** 2 < 1) AND NOT new_high AND day_chg > -50 AND day_chg <= 50 AND last_price % 7 > 1 AND last_price NOT IN (1, 2)) OR (above_sma50 AND last_price / 2 + 0.5 <> 700)
OR (last_price - floor(last_price / -7) * -7 > -1 AND day_chg < 0)""",
    "bar_violations": """WITH t AS (SELECT event_type AS symbol, date_trunc('minute', ts::TIMESTAMP) AS ts, value AS v, CASE WHEN value > 10 THEN 'rth' WHEN value > 5 THEN 'night' END AS session FROM events)
SELECT count(*) FILTER (symbol IS NULL) AS no_symbol, count(*) FILTER (ts IS NULL) AS no_ts, count(*) FILTER (v IS NULL) AS no_close, count(*) FILTER (v - 1 < v) AS high_below_low,
count(*) FILTER (v - 50 < 0) AS negative_volume, count(*) FILTER (coalesce(session <> 'rth', true)) AS unknown_session, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, ts FROM t)))::BIGINT AS repeated_key FROM t""",
    "scan_errors": f"""WITH {DAILY}, {WATCH}, {first_close(528)}
SELECT watch.symbol, CASE WHEN n IS NULL THEN 'no data returned' WHEN n < 498 THEN 'only ' || n || ' bars, 498 are needed' ELSE 'failing: index 0 of an array of 0' END AS error
FROM watch LEFT JOIN c USING (symbol) WHERE coalesce(n, 0) < 498 OR first_close <= 1400""",
    "scan_meta": f"""WITH {DAILY}, {WATCH}, {first_close(300)}, r AS (SELECT watch.symbol, newest, n IS NOT NULL AND n >= 250 AND first_close > 1400 AS ok FROM watch LEFT JOIN c USING (symbol))
SELECT count(*) AS requested, count(*) FILTER (ok) AS scanned, count(*) FILTER (NOT ok) AS failed, max(newest) AS newest_bar FROM r""",
    "script_features": f"""WITH {DAILY}, m AS (SELECT *, {over('avg(close)', 'close', 8)} AS mean FROM bars)
SELECT symbol, ts, {q('mean', 'mean')}, {q('close - mean', 'dev')}, {q(f'coalesce(close - lag(close, 2) OVER ({W}), -1)', 'gap')}, {q(f'avg(close) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'box_avg')},
{q('CASE WHEN close > open THEN sqrt(volume) ELSE abs(open - close) END', 'pick')}, {q('greatest(floor(high), ceil(low)) + least(sign(close - open), 0)', 'whole')} FROM m""",
}

#: The bucket of a bar, the Eastern clock being five hours behind in January.
BUCKETS = {
    "60": "floor((epoch(ts) - anchor) / 3600)", "240": "floor((epoch(ts) - anchor) / 14400)",
    "D": "epoch(date_trunc('day', ts - INTERVAL '5 hours'))", "W": "epoch(date_trunc('week', ts - INTERVAL '5 hours'))",
}


def higher(timeframe: str) -> str:
    return f"""WITH {events(15)},
a AS (SELECT *, epoch(date_trunc('day', min(ts) OVER (PARTITION BY symbol) - INTERVAL '5 hours')) + 5 * 3600 + 34200 AS anchor FROM bars),
b AS (SELECT *, {BUCKETS[timeframe]} AS b FROM a),
h AS (SELECT symbol, b, arg_max(close, ts) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM b GROUP BY symbol, b),
m AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN avg(close) OVER w END AS mean FROM h WINDOW w AS (PARTITION BY symbol ORDER BY b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
l AS (SELECT symbol, b, lag(close) OVER o AS last, lag(mean) OVER o AS mean, high - low + volume AS ahead FROM m WINDOW o AS (PARTITION BY symbol ORDER BY b))
SELECT symbol, ts, {q('last', 'last')}, {q('mean', 'mean')}, {q('ahead', 'ahead')}, {q('last', 'before')} FROM b JOIN l USING (symbol, b)"""


ORACLE |= {f"script_security_{t.lower()}": higher(t) for t in BUCKETS}

LAST_FALL = f"last_value(CASE WHEN close < open THEN close END IGNORE NULLS) OVER ({W} {FULL})"
ORACLE |= {
    "sliced_windows": simple(DAILY, q(over("avg(close)", "close", 20), "sma20"), q(over("stddev_pop(close)", "close", 20), "sd20"), q(f"close - lag(close, 10) OVER ({W})", "mom10")),
    "sliced_carries": f"{RECURSIVE}{DAILY}, {rma('bars', 'close', 'rma14', 14)}, {joined('o', 'bars', 'rma14')}, n AS (SELECT *, row_number() OVER ({W}) AS rn FROM o)\n"
    f"SELECT symbol, ts, rn AS number, {q(LAST_FALL, 'last_fall')}, {since('close < open')} AS since, {q('rma14', 'rma14')} FROM n",
}
