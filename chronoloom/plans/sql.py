"""Common table expressions of the DuckDB statements that the queries are held against."""

T0, T1 = 1_704_672_000_000_000, 1_705_881_600_000_000  # 2024-01-08 to 2024-01-22
H = 3_600_000_000

TEL = """ev AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k, epoch_us(ts) AS us FROM events),
tel_src AS (SELECT event_type AS channel, us AS ts, CASE WHEN k = 3 THEN NULL ELSE value END AS val, k = 0 AS nd, CASE WHEN k IN (1, 2) THEN k ELSE 0 END AS otkl,
  event_id + CASE WHEN event_id % 97 = 0 THEN 400 ELSE 0 END AS arrival, event_id FROM ev),
tel AS (SELECT *, arrival // 50 AS pkt, CASE WHEN val IS NULL OR isnan(val) OR nd THEN 'bad' WHEN otkl <> 0 OR val < 0.5 OR val > 100 THEN 'uncertain' ELSE 'good' END AS quality FROM tel_src),
valid AS (SELECT * FROM tel WHERE quality <> 'bad' AND val IS NOT NULL)"""

HAMPEL = """h1 AS (SELECT *, median(val) OVER w AS med, list(val) OVER w AS l, count(*) OVER w AS c FROM valid WINDOW w AS (PARTITION BY channel ORDER BY ts ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
h2 AS (SELECT *, CASE WHEN c = 15 THEN 1.4826 * list_aggregate(list_transform(l, lambda v: abs(v - med)), 'median') END AS sigma FROM h1),
hv AS (SELECT channel, ts, val, arrival, event_id, pkt, med AS median, sigma, coalesce(sigma > 0 AND abs(val - med) > 3 * sigma, false) AS substituted,
  CASE WHEN coalesce(sigma > 0 AND abs(val - med) > 3 * sigma, false) THEN med ELSE val END AS val_f FROM h2)"""

FEATURES = """fe AS (SELECT *, CASE WHEN count(*) OVER w = 30 THEN avg(val_f) OVER w END AS mean, CASE WHEN count(*) OVER w = 30 THEN stddev_pop(val_f) OVER w END AS std,
  CASE WHEN count(*) OVER w = 30 THEN min(val_f) OVER w END AS lo, CASE WHEN count(*) OVER w = 30 THEN max(val_f) OVER w END AS hi,
  CASE WHEN count(*) OVER w = 30 THEN sqrt(avg(val_f * val_f) OVER w) END AS rms,
  CASE WHEN count(*) OVER w = 30 THEN coalesce(regr_slope(val_f, (ts - 1704067200000000) / 1e6) OVER w, 0) END AS slope
  FROM hv WINDOW w AS (PARTITION BY channel ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
pr AS (SELECT *, CASE WHEN lag(mean) OVER o IS NOT NULL THEN lag(val_f) OVER o END AS pred, row_number() OVER o AS i FROM fe WINDOW o AS (PARTITION BY channel ORDER BY ts)),
rr AS MATERIALIZED (SELECT *, abs(val - pred) AS resid FROM pr)"""

ADAPTIVE = """ad AS (SELECT channel, 0::BIGINT AS i, 0::BIGINT AS n, 0.0::DOUBLE AS ema, NULL::DOUBLE AS thr, false AS anomaly FROM (SELECT DISTINCT channel FROM rr)
  UNION ALL
  SELECT channel, i, CASE WHEN resid IS NULL OR f THEN n ELSE n + 1 END, CASE WHEN resid IS NULL OR f THEN ema WHEN n = 0 THEN resid ELSE ema + greatest(0.01, 1.0::DOUBLE / (n + 1)) * (resid - ema) END, t, f
  FROM (SELECT *, coalesce(t > 0 AND resid > t, false) AS f FROM (SELECT r.channel, r.i, r.resid, a.n, a.ema, CASE WHEN r.resid IS NOT NULL AND a.n >= 100 THEN 3 * sqrt(pi() / 2) * a.ema END AS t
    FROM ad a JOIN rr r ON r.channel = a.channel AND r.i = a.i + 1))),
dg AS MATERIALIZED (SELECT rr.*, ad.thr, ad.anomaly FROM rr JOIN ad USING (channel, i))"""

SCORED = """fl AS (SELECT channel, 'anomaly' AS kind, ts, val, coalesce(resid / nullif(thr, 0), 1.0) AS score FROM dg WHERE anomaly
  UNION ALL SELECT channel, 'outlier', ts, val, abs(val - median) FROM dg WHERE substituted)"""

EPISODES = f"""isl AS (SELECT *, sum(CASE WHEN ts - p <= {6 * H} THEN 0 ELSE 1 END) OVER (PARTITION BY channel, kind ORDER BY ts)::BIGINT AS island
  FROM (SELECT *, lag(ts) OVER (PARTITION BY channel, kind ORDER BY ts) AS p FROM fl)),
ep AS MATERIALIZED (SELECT channel, kind, min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS n_points, arg_min(ts, (-score, ts)) AS peak_ts, arg_min(val, (-score, ts)) AS peak_value, max(score) AS score
  FROM isl GROUP BY channel, kind, island)"""

DIAGNOSIS = f"{TEL}, {HAMPEL}, {FEATURES}, {ADAPTIVE}"
FULL = f"{DIAGNOSIS}, {SCORED}, {EPISODES}"

BUCKET = """min(val) AS vmin, arg_min(ts, (val, ts)) AS tmin, max(val) AS vmax, arg_min(ts, (-val, ts)) AS tmax, arg_min(val, ts) AS vfirst, min(ts) AS tfirst, arg_max(val, ts) AS vlast, max(ts) AS tlast,
  round(sum(val), 6) AS vsum, count(*) AS cnt"""

LEVELS = f"""lv AS (SELECT *, (({H} * 4 ** lvl)::BIGINT) AS width FROM (SELECT unnest([0, 1, 2, 3])::INT AS lvl)),
agg AS MATERIALIZED (SELECT channel, lvl, ts // width * width AS bucket, any_value(width) AS width, {BUCKET} FROM tel, lv WHERE val IS NOT NULL GROUP BY ALL)"""
LEVELS = LEVELS.replace(", any_value(width) AS width", "").replace("GROUP BY ALL", "GROUP BY channel, lvl, ts // width * width")

LABELS = f"""lab AS (SELECT event_id AS label_id, event_type AS channel, us AS ts_start, us + {H} AS ts_end, (['impulse', 'level_shift', 'drift'])[event_id % 3 + 1] AS type FROM ev WHERE value > 220 OR event_id % 401 = 0)"""

FLAGS = "pf AS (SELECT channel, 'online' AS run, ts, val, val_f, substituted, anomaly FROM dg WHERE substituted OR anomaly)"

REGISTRY = "reg(channel, x_min, x_max, hampel_window, hampel_kappa, analytics_enabled) AS (VALUES ('click', 0.5, 100.0, NULL, NULL, true), ('error', 0.5, 100.0, NULL, 4.0, true), ('purchase', 0.5, 100.0, NULL, NULL, true), ('view', 0.5, 100.0, 21, NULL, true), ('ghost', NULL, NULL, NULL, NULL, false))"
RULES = f"""rules(rule_id, channel, kind, lim, deadband, on_delay, off_delay, min_repeat, enabled) AS (VALUES (1, 'click', 'hi', 80.0, 20.0, 0, 0, 0, true), (2, 'error', 'hihi', 60.0, 0.0, {H}, {H}, 0, true),
  (3, 'view', 'lo', 5.0, 2.0, {H // 6}, 0, {6 * H}, true), (4, 'purchase', 'anomaly', NULL, 0.0, 0, 0, 0, true), (5, 'click', 'lolo', 1.0, 0.0, 0, 0, 0, false))"""
MODES = "modes AS (SELECT 'r' || (user_id % 4) AS robot, (['idle', 'work', 'service'])[event_id % 3 + 1] AS mode, us AS ts, event_id AS mode_id FROM ev WHERE event_type = 'signup' AND event_id % 50 = 0)"

# readings of all rows: the filtered value where valid, else the raw one; anomaly only where valid
READINGS = "rd AS (SELECT t.channel, t.ts, coalesce(d.val_f, t.val) AS value, coalesce(d.anomaly, false) AS anomaly FROM tel t LEFT JOIN dg d USING (channel, ts))"
PAIRS = """pairs AS MATERIALIZED (SELECT r.rule_id, r.channel, r.kind, r.lim::DOUBLE AS lim, r.deadband::DOUBLE AS deadband, r.on_delay, r.off_delay, r.min_repeat, x.ts, x.value, x.anomaly
  FROM rd x JOIN rules r USING (channel) WHERE r.enabled AND (r.kind = 'anomaly' OR r.lim IS NOT NULL))"""
LIFECYCLE = f"""inp AS (SELECT rule_id, channel, kind, lim, deadband, on_delay, off_delay, min_repeat, ts, value, anomaly, 0 AS is_ack, NULL::VARCHAR AS who FROM pairs
  UNION ALL SELECT r.rule_id, r.channel, r.kind, r.lim, r.deadband, r.on_delay, r.off_delay, r.min_repeat, t.ts, NULL, false, 1, 'operator' FROM tel t JOIN rules r ON r.rule_id = 1 + t.event_id % 4 WHERE t.event_id % 500 = 7 AND r.enabled),
st AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts, is_ack) AS i FROM inp),
mc AS (SELECT rule_id, 0::BIGINT AS i, 'normal' AS s, false AS c, NULL::BIGINT AS since, NULL::BIGINT AS last_on, NULL::VARCHAR AS what, NULL::VARCHAR AS s0 FROM (SELECT DISTINCT rule_id FROM st)
  UNION ALL
  SELECT rule_id, i, CASE WHEN what = 'activated' THEN 'unack_active' WHEN what = 'returned' THEN CASE WHEN s = 'unack_active' THEN 'unack_rtn' ELSE 'normal' END
      WHEN what = 'acknowledged' THEN CASE WHEN s = 'unack_active' THEN 'ack_active' ELSE 'normal' END ELSE s END,
    CASE WHEN flip THEN raw ELSE c END, CASE WHEN is_ack = 1 THEN since WHEN flip OR raw = c THEN NULL ELSE since2 END, CASE WHEN flip AND raw THEN ts ELSE last_on END, what, s
  FROM (SELECT *, CASE WHEN is_ack = 1 THEN CASE WHEN s IN ('unack_active', 'unack_rtn') THEN 'acknowledged' END
        WHEN flip AND raw AND s IN ('normal', 'unack_rtn') THEN 'activated' WHEN flip AND NOT raw AND s IN ('unack_active', 'ack_active') THEN 'returned' END AS what
    FROM (SELECT *, is_ack = 0 AND raw <> c AND ts - since2 >= CASE WHEN raw THEN on_delay ELSE off_delay END AND NOT (raw AND last_on IS NOT NULL AND ts - last_on < min_repeat) AS flip
      FROM (SELECT *, coalesce(since, ts) AS since2 FROM (SELECT st.*, m.s, m.c, m.since, m.last_on, CASE WHEN st.kind = 'anomaly' THEN st.anomaly WHEN st.value IS NULL THEN m.c
          WHEN st.kind IN ('hi', 'hihi') THEN st.value > st.lim - CASE WHEN m.c THEN st.deadband ELSE 0 END ELSE st.value < st.lim + CASE WHEN m.c THEN st.deadband ELSE 0 END END AS raw
        FROM mc m JOIN st ON st.rule_id = m.rule_id AND st.i = m.i + 1))))),
lg AS MATERIALIZED (SELECT st.rule_id, st.channel, st.ts, mc.what AS transition, mc.s0 AS state_from, mc.s AS state_to, CASE WHEN st.is_ack = 0 THEN st.value END AS value, st.who AS "user", st.i
  FROM mc JOIN st USING (rule_id, i) WHERE mc.what IS NOT NULL)"""
ALARMS = f"{FULL}, {RULES}, {READINGS}, {PAIRS}, {LIFECYCLE}"
OCCURRENCES = """oc AS MATERIALIZED (SELECT rule_id, occurrence, arg_max(state_to, i) AS state, min(ts) AS ts_active, CASE WHEN arg_max(transition, i) FILTER (transition <> 'acknowledged') = 'returned' THEN arg_max(ts, i) FILTER (transition <> 'acknowledged') END AS ts_return,
    max(ts) FILTER (transition = 'acknowledged') AS ts_ack, arg_max("user", i) FILTER (transition = 'acknowledged') AS acked_by, arg_min(value, i) AS value
  FROM (SELECT *, greatest(1, sum(CASE WHEN transition = 'activated' AND state_from = 'normal' THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id ORDER BY i))::BIGINT AS occurrence FROM lg) GROUP BY rule_id, occurrence)"""

# channels' points of T0..T1 for charts: preselection in 80 buckets, then LTTB to 80 points
PRESELECT = f"""cs AS (SELECT channel, ts, val FROM tel WHERE val IS NOT NULL AND ts >= {T0} AND ts < {T1}),
sp AS (SELECT channel, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM cs GROUP BY 1),
bk AS (SELECT cs.*, t0, t1, n, ((ts - t0)::HUGEINT * 80 // (greatest(t1 - t0, 1) + 1))::BIGINT AS b FROM cs JOIN sp USING (channel)),
pre AS MATERIALIZED (SELECT channel, ts, val FROM bk WHERE 160 >= n UNION
  SELECT channel, ts, val FROM bk WHERE 160 < n AND ts IN (t0, t1) UNION
  SELECT channel, arg_min(ts, (val, ts)), min(val) FROM bk WHERE 160 < n GROUP BY channel, b UNION
  SELECT channel, arg_min(ts, (-val, ts)), max(val) FROM bk WHERE 160 < n GROUP BY channel, b)"""
LTTB = """pn AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n, (ts - min(ts) OVER (PARTITION BY channel))::DOUBLE AS t FROM pre),
pb AS (SELECT channel, j, any_value(n) AS n, (j * ((n - 2)::DOUBLE / 78))::DOUBLE AS x FROM (SELECT DISTINCT channel, n FROM pn WHERE n > 80), (SELECT unnest(range(0, 80)) AS j) GROUP BY channel, j, n),
pe AS (SELECT channel, j, n, floor(x)::BIGINT + 1 AS e FROM pb),
ce AS (SELECT a.channel, a.j, avg(p.t) AS ct, avg(p.val) AS cx FROM (SELECT channel, j, n, e AS lo, lead(e) OVER (PARTITION BY channel ORDER BY j) AS hi FROM pe) a JOIN pn p ON p.channel = a.channel AND p.i >= a.lo AND p.i < least(coalesce(a.hi, a.n), a.n) GROUP BY 1, 2),
ls AS (SELECT channel, t AS ct, val AS cx FROM pn WHERE i = n - 1),
cand AS MATERIALIZED (SELECT p.channel, a.j, p.i, p.t, p.val, coalesce(ce.ct, ls.ct) AS ct, coalesce(ce.cx, ls.cx) AS cx FROM (SELECT channel, j, e AS lo, lead(e) OVER (PARTITION BY channel ORDER BY j) AS hi FROM pe) a
  JOIN pn p ON p.channel = a.channel AND p.i >= a.lo AND p.i < a.hi LEFT JOIN ce ON ce.channel = a.channel AND ce.j = a.j + 1 JOIN ls ON ls.channel = a.channel WHERE a.j < 78),
pk AS (SELECT channel, -1::BIGINT AS j, i, t, val FROM pn WHERE i = 0 AND n > 80
  UNION ALL SELECT channel, j, i, t, val FROM (SELECT c.channel, c.j, c.i, c.t, c.val, row_number() OVER (PARTITION BY c.channel ORDER BY abs((k.t - c.ct) * (c.val - k.val) - (k.t - c.t) * (c.cx - k.val)) DESC, c.i) AS r
    FROM pk k JOIN cand c ON c.channel = k.channel AND c.j = k.j + 1) WHERE r = 1),
lt AS MATERIALIZED (SELECT channel, ts, val FROM pn WHERE n <= 80 OR i = n - 1 UNION SELECT p.channel, p.ts, p.val FROM pk JOIN pn p ON p.channel = pk.channel AND p.i = pk.i)"""


HITS = f"""hit AS (SELECT l.label_id, min(e.ts_start) AS e_first FROM lab l JOIN ep e ON e.channel = l.channel AND e.kind = 'anomaly' AND e.ts_start <= l.ts_end + {H // 2} AND e.ts_end >= l.ts_start - {H // 2} GROUP BY 1),
lo AS (SELECT l.*, h.e_first IS NOT NULL AS detected, greatest(0, h.e_first - l.ts_start) / 1e6 AS delay_s FROM lab l LEFT JOIN hit h USING (label_id)),
tp AS (SELECT e.* FROM ep e WHERE kind = 'anomaly' AND EXISTS (SELECT 1 FROM lab l WHERE l.channel = e.channel AND e.ts_start <= l.ts_end + {H // 2} AND e.ts_end >= l.ts_start - {H // 2}))"""
METRICS = """mt AS (SELECT channel, episodes, labels, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(mean_delay_s, 6) AS mean_delay_s FROM (
SELECT channel, count(*) AS labels, count(*) FILTER (detected) / count(*) AS r, avg(CASE WHEN detected THEN delay_s END) AS mean_delay_s, (SELECT count(*) FROM ep WHERE kind = 'anomaly' AND ep.channel = lo.channel) AS episodes,
(SELECT count(*) FROM tp WHERE tp.channel = lo.channel) / nullif((SELECT count(*) FROM ep WHERE kind = 'anomaly' AND ep.channel = lo.channel), 0) AS p FROM lo GROUP BY channel)),
mo AS (SELECT labels, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(mean_delay_s, 6) AS mean_delay_s FROM (
SELECT count(*) AS labels, count(*) FILTER (detected) / count(*) AS r, avg(CASE WHEN detected THEN delay_s END) AS mean_delay_s,
(SELECT count(*) FROM tp) / nullif((SELECT count(*) FROM ep WHERE kind = 'anomaly' AND channel IN (SELECT channel FROM lab)), 0) AS p FROM lo))"""

# points that aren't too late for their bucket, with one flush after each packet
ON_TIME = f"""seen AS (SELECT channel, pkt, max(top) OVER (PARTITION BY channel ORDER BY pkt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT channel, pkt, max(ts) AS top FROM tel GROUP BY 1, 2)),
sagg AS (SELECT channel, lvl, ts // width * width AS bucket, {BUCKET} FROM tel JOIN seen USING (channel, pkt), lv WHERE val IS NOT NULL AND NOT coalesce(ts // width * width < seen - {6 * H} - width, false) GROUP BY channel, lvl, ts // width * width)"""

# chart cells of 12 hours: gp has the final picks, gt the tail of the last two cells
CELLS = f"""gc AS (SELECT channel, ts, val, c, dense_rank() OVER (PARTITION BY channel ORDER BY c) AS r, row_number() OVER (PARTITION BY channel, c ORDER BY ts) AS i FROM (SELECT channel, ts, val, ts // {12 * H} AS c FROM tel WHERE val IS NOT NULL)),
gn AS (SELECT channel, max(r) AS n FROM gc GROUP BY 1),
gm AS (SELECT channel, r, min(ts) AS base, avg((ts - c * {12 * H})::DOUBLE) + min(c) * {12 * H}::DOUBLE AS ct0, avg(val) AS cx FROM gc GROUP BY 1, 2),
ge AS (SELECT channel, r, avg(off) AS ct, any_value(cx) AS cx, any_value(base) AS base FROM (SELECT a.channel, a.r, a.base, (g.ts - a.base)::DOUBLE AS off, b.cx FROM gm a JOIN gc g ON g.channel = a.channel AND g.r = a.r + 1 JOIN gm b ON b.channel = a.channel AND b.r = a.r + 1) GROUP BY 1, 2),
gp AS (SELECT channel, 1::BIGINT AS r, ts, val FROM gc JOIN gn USING (channel) WHERE r = 1 AND i = 1 AND n >= 3
  UNION ALL SELECT channel, r, ts, val FROM (SELECT g.channel, g.r, g.ts, g.val, row_number() OVER (PARTITION BY g.channel ORDER BY abs(((k.ts - e.base)::DOUBLE - e.ct) * (g.val - k.val) - ((k.ts - e.base)::DOUBLE - (g.ts - e.base)::DOUBLE) * (e.cx - k.val)) DESC, g.ts) AS best
    FROM gp k JOIN gn ON gn.channel = k.channel AND k.r + 1 <= n - 2 JOIN gc g ON g.channel = k.channel AND g.r = k.r + 1 JOIN ge e ON e.channel = k.channel AND e.r = k.r + 1) WHERE best = 1),
gl AS (SELECT channel, r, arg_min(ts, (val, ts)) AS lo, arg_min(ts, (-val, ts)) AS hi, max(ts) AS last FROM gc JOIN gn USING (channel) WHERE r > n - 2 GROUP BY 1, 2),
gt AS (SELECT DISTINCT g.channel, g.ts, g.val FROM gc g JOIN gl ON gl.channel = g.channel AND gl.r = g.r WHERE g.ts IN (lo, hi, last))"""


def with_model(rows: str, restarts: bool) -> str:
    """DIAGNOSIS where ``rows`` have a fixed linear forecaster, sigma 20 and a classifier. With ``restarts``, view begins
    anew at T0 with another factor, as the channel view+, and those rows' first one has no forecast."""
    parts = TEL, HAMPEL, FEATURES, ADAPTIVE
    if restarts:
        parts = parts[0].replace("SELECT event_type AS channel", f"SELECT CASE WHEN event_type = 'view' AND us >= {T0} THEN 'view+' ELSE event_type END AS channel"), *parts[1:]
    first = f"AND NOT coalesce(lag(ts) OVER o < {T0}, true)" if restarts else ""
    pred = f"CASE WHEN {rows} THEN CASE WHEN lag(mean) OVER o IS NOT NULL {first} THEN lag(0.5 * val_f + 0.5 * mean) OVER o END WHEN lag(mean) OVER o IS NOT NULL THEN lag(val_f) OVER o END AS pred"
    features = parts[2].replace("CASE WHEN lag(mean) OVER o IS NOT NULL THEN lag(val_f) OVER o END AS pred", pred)
    features = features.replace("SELECT *, abs(val - pred) AS resid FROM pr", f"SELECT *, abs(val - pred) AS resid, CASE WHEN {rows} THEN 1 / (1 + exp(40.0 - std)) END AS prob, {rows} AS fixed FROM pr")
    assert pred in features and "AS fixed" in features
    adaptive = parts[3].replace("r.resid, a.n", "r.resid, r.fixed, r.prob, a.n").replace("3 * sqrt(pi() / 2) * a.ema", "CASE WHEN r.channel = 'view+' THEN 4 ELSE 3 END * sqrt(pi() / 2) * a.ema")
    adaptive = adaptive.replace("CASE WHEN r.resid IS NOT NULL AND a.n >= 100", "CASE WHEN r.fixed THEN CASE WHEN r.resid IS NOT NULL THEN 60.0 END WHEN r.resid IS NOT NULL AND a.n >= 100")
    adaptive = adaptive.replace("coalesce(t > 0 AND resid > t, false) AS f", "coalesce(t > 0 AND resid > t, false) OR coalesce(prob > 0.5, false) AS f")
    return f"{parts[0]}, {parts[1]}, {features}, {adaptive}"


def sql(select: str, *parts: str, recursive: bool = False) -> str:
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else "") + select
