"""DuckDB SQL that computes the same results from the same tables, written on its own terms.

``_sel`` marks a column's kind by its first letter: ``#`` whole numbers, ``$`` as it is, else a rounded double.
"""

from __future__ import annotations

from .. import config as C

S = C.FIXTURE
_ITEMISH = "event_name IN ('item_view','photo_swipe','seller_page_view','contact_phone_show','contact_chat_open','contact_message_sent','favorite_add')"
CLICKS = f"""raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
placed AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN (user_id + 1) % 4 ELSE user_id % 4 END AS p,
  CASE event_type WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'item_view' ELSE 'search_results_view' END
    WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'seller_page_view' ELSE 'photo_swipe' END
    WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'favorite_add' ELSE 'login' END
    WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'contact_phone_show' WHEN 1 THEN 'contact_chat_open' ELSE 'contact_message_sent' END
    ELSE CASE WHEN k % 4 = 0 THEN 'captcha_shown' ELSE 'search_results_view' END END AS event_name FROM raw),
clicks AS (SELECT event_id, user_id AS cookie_id, date_trunc('second', ts) AS event_ts, event_name,
  CASE p WHEN 0 THEN CASE event_id % 3 WHEN 0 THEN 'WEB' WHEN 1 THEN 'Web' ELSE 'web' END WHEN 1 THEN 'desktop' WHEN 2 THEN 'ANDROID' ELSE CASE WHEN event_id % 2 = 0 THEN 'iphone' ELSE 'IOS' END END AS raw_platform,
  CASE WHEN user_id % 12 = 3 THEN CASE k % 3 WHEN 0 THEN 'python-requests/2.' WHEN 1 THEN 'node-fetch/1.' ELSE 'python-urllib3/2.' END || (k % 5) WHEN p = 0 AND user_id % 5 = 0 THEN 'Mozilla/5.0 (Macintosh) Version/17 Safari/605' WHEN p = 0 THEN 'Mozilla/5.0 Chrome/' || (100 + user_id % 20) || ' Safari/537' WHEN p = 1 THEN 'Mozilla/5.0 Firefox/' || (110 + user_id % 9)
    WHEN p = 2 THEN 'NativeApp/' || (120 + user_id % 5) || ' (Android ' || (10 + user_id % 4) || '; Pixel ' || (user_id % 6) || ')' ELSE 'NativeApp/121 (iPhone; iOS 16.2; Phone ' || (user_id % 6) || ')' END AS user_agent,
  CASE WHEN {_ITEMISH} THEN 100000 + (k * 97 + user_id * 13 + event_id % 5) % 5000 END AS item_id,
  CASE WHEN {_ITEMISH} THEN 'cat_' || (k % 15) END AS item_category, CASE WHEN {_ITEMISH} THEN 'loc_' || ((k + user_id) % 60) END AS item_location,
  CASE WHEN event_name = 'search_results_view' THEN CASE WHEN k % 30 = 7 THEN 'o''q.7' ELSE 'q_' || (k % 30) END END AS search_query, CASE WHEN event_name = 'search_results_view' THEN CAST(1 + floor(value / 15) AS BIGINT) END AS search_page,
  CASE WHEN {_ITEMISH} AND k % 10 <> 9 THEN CASE WHEN k % 4 = 0 THEN 'pro' ELSE 'private' END END AS seller_type,
  CASE WHEN p IN (0, 1) AND event_id % 3 <> 0 THEN CAST(CAST(floor(value * 40) AS BIGINT) % 1920 AS DOUBLE) END AS pointer_x, CASE WHEN p IN (0, 1) AND event_id % 3 <> 0 THEN CAST((k * 11) % 1080 AS DOUBLE) END AS pointer_y
  FROM placed),
cookies AS (SELECT DISTINCT user_id AS cookie_id, TIMESTAMP '2024-01-01' + to_days(CAST(user_id % 8 AS INT)) AS window_start_ts, TIMESTAMP '2024-01-01' + to_days(CAST(user_id % 8 AS INT)) + to_days(14) AS window_end_ts,
  TIMESTAMP '2024-01-01' + to_days(CAST(user_id % 8 AS INT)) - to_hours(CAST(user_id * 37 % 400 AS INT)) AS cookie_created_at, user_id % 8 AS day_index, user_id % 8 < 5 AS is_fit, CASE WHEN user_id % 12 IN (3, 7) THEN 1 ELSE 0 END AS target FROM events),
ev0 AS (SELECT c.*, CASE WHEN lower(raw_platform) = 'iphone' THEN 'ios' ELSE lower(raw_platform) END AS platform, CAST(epoch(event_ts) AS BIGINT) AS sec, m.is_fit, m.target
  FROM clicks c JOIN cookies m USING (cookie_id) WHERE event_ts >= window_start_ts AND event_ts < window_end_ts)"""
_P = "PARTITION BY cookie_id ORDER BY event_ts, event_id"


def _enriched(where: str = "TRUE") -> str:
    return f""", e1 AS (SELECT *, sec - lag(sec) OVER ({_P}) AS dt, lead(sec) OVER ({_P}) - sec AS dwell, lag(event_name) OVER ({_P}) AS prev_name FROM ev0 WHERE {where}),
e2 AS (SELECT *, lag(dt) OVER ({_P}) AS dt_before, lag(dt, 2) OVER ({_P}) AS dt_third, CAST(floor(ln(1 + dt)) AS BIGINT) AS bucket FROM e1),
ev AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > {S.session_gap} THEN 1 ELSE 0 END) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sess FROM e2)"""


def _sel(facts: dict[str, str], key: str = "$cookie_id") -> str:
    def one(name: str, e: str) -> str:
        return f"CAST({e} AS BIGINT) AS {name[1:]}" if name[0] == "#" else f"{e} AS {name[1:]}" if name[0] == "$" else f"round(CAST({e} AS DOUBLE), 6) AS {name}"

    return "SELECT " + ", ".join(([key[1:]] if key else []) + [one(n, e) for n, e in facts.items()])


def _q(more: str, facts: dict[str, str], tail: str, where: str = "TRUE", key: str = "$cookie_id") -> str:
    return f"WITH {CLICKS}{_enriched(where)}{', ' + more if more else ''} {_sel(facts, key)} {tail}"


def _entropy(name: str, column: str, source: str = "ev") -> str:
    return f"{name} AS (SELECT cookie_id, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h, max(c) / sum(c) AS top FROM (SELECT cookie_id, {column} AS v, count(*) AS c FROM {source} WHERE {column} IS NOT NULL GROUP BY 1, 2) GROUP BY cookie_id)"


def _cnt(name: str) -> str:
    return f"count(*) FILTER (event_name = '{name}')"


def _in(xs: tuple[str, ...]) -> str:
    return "event_name IN (" + ", ".join(f"'{x}'" for x in xs) + ")"


def _corr(x: str, y: str) -> str:
    ok = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    n, sx, sy, sxx, syy, sxy = (f"sum(CASE WHEN {ok} THEN CAST({e} AS DOUBLE) END)" for e in ("1", x, y, f"{x}*{x}", f"{y}*{y}", f"{x}*{y}"))
    spread = f"(({n} * {sxx} - {sx} * {sx}) * ({n} * {syy} - {sy} * {sy}))"
    return f"CASE WHEN {n} > 2 AND {spread} > 1e-9 THEN ({n} * {sxy} - {sx} * {sy}) / sqrt({spread}) END"


def _volume() -> str:
    f = {"#n_events": "count(*)", "n_events_log": "ln(1 + count(*))"}
    for x in C.EVENT_NAMES:
        f |= {f"#cnt_{x}": _cnt(x), f"rate_{x}": f"{_cnt(x)} / count(*)"}
    f |= {"rate_engagement": f"count(*) FILTER ({_in(C.ENGAGEMENT)}) / count(*)", "rate_contact": f"count(*) FILTER ({_in(C.CONTACT)}) / count(*)"}
    f |= {"ratio_search_item": f"{_cnt('search_results_view')} / ({_cnt('item_view')} + 1)", "ratio_photo_item": f"{_cnt('photo_swipe')} / ({_cnt('item_view')} + 1)"}
    f |= {"ratio_contact_seller": f"(count(*) FILTER ({_in(C.CONTACT)}) / count(*)) / ({_cnt('seller_page_view')} / count(*) + 0.01::DOUBLE)", "#n_active_hours": "count(DISTINCT hour(event_ts))", "events_per_active_hour": "count(*) / count(DISTINCT hour(event_ts))"}
    f |= {"night_rate": "avg(CASE WHEN hour(event_ts) BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END)", "hour_entropy": "any_value(h.h)"}
    return _q(_entropy("h", "hour(event_ts)"), f, "FROM ev JOIN h USING (cookie_id) GROUP BY cookie_id")


_TOP = f"pairs AS (SELECT *, prev_name || '>' || event_name AS pair FROM ev WHERE prev_name IS NOT NULL), top AS (SELECT pair, count(*) AS n FROM pairs WHERE is_fit GROUP BY pair ORDER BY n DESC, pair LIMIT {S.top_bigrams})"


def _transitions() -> str:
    """The 25 shares come as (bigram, share) rows, as a pivot's columns depend on the data."""
    f = {"$pair": "top.pair", "share": "count(*) FILTER (pairs.pair = top.pair) / count(*)", "self_loop_rate": "avg(CASE WHEN prev_name = event_name THEN 1.0 ELSE 0.0 END)", "#n_bigrams_uniq": "count(DISTINCT pairs.pair)", "bigram_entropy": "any_value(h.h)"}
    return _q(f"{_TOP}, {_entropy('h', 'pair', 'pairs')}", f, "FROM pairs JOIN h USING (cookie_id) CROSS JOIN top GROUP BY cookie_id, top.pair", key="$cookie_id")


def _timing_facts(prefix: str = "") -> dict[str, str]:
    f = {f"dt_q{int(q * 100)}": f"quantile_cont(dt, {q})" for q in (0.1, 0.25, 0.5, 0.75, 0.9)}
    f |= {"#dt_min": "min(dt)", "#dt_max": "max(dt)", "dt_mean": "avg(dt)", "dt_std": "stddev_samp(dt)", "dt_iqr": "quantile_cont(dt, 0.75) - quantile_cont(dt, 0.25)", "dt_cv": "stddev_samp(dt) / (avg(dt) + 1)"}
    f |= {"dt_mad": "quantile_cont(abs(dt - mid), 0.5)", "dt_burstiness": "(stddev_samp(dt) - avg(dt)) / (stddev_samp(dt) + avg(dt) + 1)", "dt_fano": "stddev_samp(dt) * stddev_samp(dt) / (avg(dt) + 1)", "dt_rel_iqr": "(quantile_cont(dt, 0.75) - quantile_cont(dt, 0.25)) / (quantile_cont(dt, 0.5) + 1)"}
    f |= {f"dt_lt{k}": f"avg(CASE WHEN dt IS NULL THEN NULL WHEN dt < {k} THEN 1.0 ELSE 0.0 END)" for k in S.fast_gaps}
    f |= {"dt_log_entropy": "any_value(h.h)", "dt_mode_share": "any_value(h.top)", "dt_autocorr1": _corr("dt", "dt_before"), "span_h": "(max(sec) - min(sec)) / 3600.0", "events_per_h": "count(*) / greatest((max(sec) - min(sec)) / 3600.0, 1 / 60.0)"}
    return {(n[0] + prefix + n[1:] if n[0] == "#" else prefix + n): e for n, e in f.items()}


_MID = "mids AS (SELECT cookie_id, quantile_cont(dt, 0.5) AS mid FROM ev GROUP BY cookie_id)"
_TIMING_FROM = "FROM ev LEFT JOIN mids USING (cookie_id) LEFT JOIN h USING (cookie_id) GROUP BY cookie_id"


def _timing(where: str = "TRUE", prefix: str = "") -> str:
    return _q(f"{_MID}, {_entropy('h', 'bucket')}", _timing_facts(prefix), _TIMING_FROM, where)


def _sessions() -> str:
    each = "s0 AS (SELECT cookie_id, sess, count(*) AS n, min(sec) AS a, max(sec) AS b FROM ev GROUP BY 1, 2), s1 AS (SELECT *, a - lag(a) OVER (PARTITION BY cookie_id ORDER BY sess) AS gap, b - a AS dur FROM s0)"
    f = {"#n_sessions": "count(*)", "sess_events_mean": "avg(n)", "#sess_events_max": "max(n)", "sess_events_std": "stddev_samp(n)", "sess_dur_mean": "avg(dur)", "#sess_dur_max": "max(dur)", "sess_rate_mean": "avg(n / (dur + 1))", "sess_longest_share": "max(n) / sum(n)", "sess_gap_mean": "avg(gap)"}
    return _q(each, f, "FROM s1 GROUP BY cookie_id")


def _content() -> str:
    f, ctes, joins = {}, [], []
    for i, c in enumerate(("item_category", "item_location", "item_id", "search_query")):
        f |= {f"#{c}_nuniq": f"count(DISTINCT {c})", f"{c}_uniq_ratio": f"count(DISTINCT {c}) / (count({c}) + 1)", f"{c}_per_event": f"count(DISTINCT {c}) / count(*)", f"{c}_entropy": f"any_value(h{i}.h)"}
        ctes.append(_entropy(f"h{i}", c))
        joins.append(f"LEFT JOIN h{i} USING (cookie_id)")
    f |= {"seller_pro_rate": "count(*) FILTER (seller_type = 'pro') / nullif(count(seller_type), 0)", "seller_known_rate": "count(seller_type) / count(*)", "item_repeat_rate": "1 - count(DISTINCT item_id) / (count(item_id) + 1)"}
    f |= {"items_per_category": "count(DISTINCT item_id) / (count(DISTINCT item_category) + 1)", "locations_per_category": "count(DISTINCT item_location) / (count(DISTINCT item_category) + 1)"}
    return _q(", ".join(ctes), f, f"FROM ev {' '.join(joins)} GROUP BY cookie_id")


def _islands(name: str, source: str, flag: str) -> str:
    return f"{name}0 AS (SELECT *, coalesce({flag}, false) AS f FROM {source}), {name}1 AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {name}0), {name} AS (SELECT cookie_id, max(n) AS n FROM (SELECT cookie_id, g, count(*) AS n FROM {name}1 WHERE f GROUP BY 1, 2) GROUP BY cookie_id)"


def _pagination() -> str:
    more = f"paged AS (SELECT *, search_page - lag(search_page) OVER ({_P}) AS step FROM ev WHERE search_page IS NOT NULL), {_islands('r', 'paged', 'step = 1')}"
    f = {"page_mean": "avg(search_page)", "#page_max": "max(search_page)", "page_std": "stddev_samp(search_page)", "page_first_share": "avg(CASE WHEN search_page IS NULL THEN NULL WHEN search_page = 1 THEN 1.0 ELSE 0.0 END)", "page_deep_share": f"avg(CASE WHEN search_page IS NULL THEN NULL WHEN search_page > {S.deep_page} THEN 1.0 ELSE 0.0 END)"}
    f |= {"page_step_up_share": "avg(CASE WHEN search_page IS NULL THEN NULL WHEN step = 1 THEN 1.0 ELSE 0.0 END)", "#page_step_up_count": "count(search_page) FILTER (step = 1)", "#queries_nuniq": "CASE WHEN count(search_page) > 0 THEN count(DISTINCT search_query) END", "pages_per_query": "CASE WHEN count(search_page) > 0 THEN count(search_page) / (count(DISTINCT search_query) + 1) END", "query_repeat_rate": "1 - count(DISTINCT search_query) / nullif(count(search_page), 0)", "query_len_mean": "avg(length(search_query))", "#page_run_max": "CASE WHEN count(search_page) > 0 THEN coalesce(any_value(r.n), 0) END"}
    return _q(more, f, "FROM (SELECT DISTINCT cookie_id FROM ev) v LEFT JOIN paged USING (cookie_id) LEFT JOIN r USING (cookie_id) GROUP BY cookie_id")


_MOVES = f"""m0 AS (SELECT *, pointer_x - lag(pointer_x) OVER ({_P}) AS dx, pointer_y - lag(pointer_y) OVER ({_P}) AS dy, sec - lag(sec) OVER ({_P}) AS pdt FROM ev WHERE pointer_x IS NOT NULL AND pointer_y IS NOT NULL),
m1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS step, sqrt(dx * dx + dy * dy) / (pdt + 1) AS speed, CASE WHEN dx IS NOT NULL THEN atan2(dy, dx) END AS angle FROM m0),
m2 AS (SELECT *, abs(angle - lag(angle) OVER ({_P})) AS bend FROM m1), moves AS (SELECT *, least(bend, 2 * pi() - bend) AS turn FROM m2)"""


def _pointer(where: str = "TRUE", prefix: str = "") -> str:
    f = {"pointer_coverage": "any_value(cov)", "ptr_x_std": "stddev_samp(pointer_x)", "ptr_y_std": "stddev_samp(pointer_y)", "ptr_x_mean": "avg(pointer_x)", "ptr_y_mean": "avg(pointer_y)", "ptr_bbox": "(max(pointer_x) - min(pointer_x)) * (max(pointer_y) - min(pointer_y))"}
    f |= {"ptr_uniq_share": "count(DISTINCT CASE WHEN pointer_x IS NOT NULL THEN pointer_x * 10000 + pointer_y END) / nullif(count(pointer_x), 0)", "ptr_step_med": "quantile_cont(step, 0.5)", "ptr_step_std": "stddev_samp(step)", "ptr_speed_med": "quantile_cont(speed, 0.5)", "ptr_speed_max": "max(speed)", "ptr_step_cv": "stddev_samp(step) / (avg(step) + 1)"}
    cov = "c AS (SELECT cookie_id, count(pointer_x) / count(*) AS cov FROM ev GROUP BY cookie_id)"
    return _q(f"{_MOVES}, {cov}", {prefix + n: e for n, e in f.items()}, "FROM c LEFT JOIN moves USING (cookie_id) GROUP BY cookie_id", where)


def _pointer_deep() -> str:
    w, h = S.screen
    more = f"{_MOVES}, mv AS (SELECT *, 2 * (CASE WHEN pointer_x > {w / 2} THEN 1 ELSE 0 END) + (CASE WHEN pointer_y > {h / 2} THEN 1 ELSE 0 END) AS quadrant, sqrt((pointer_x - {w / 2}) * (pointer_x - {w / 2}) + (pointer_y - {h / 2}) * (pointer_y - {h / 2})) AS centre, floor(ln(1 + step)) AS sb FROM moves), {_entropy('h1', 'sb', 'mv')}, {_entropy('h2', 'quadrant', 'mv')}, cv AS (SELECT cookie_id, " + ", ".join(f"avg(CASE WHEN event_name = '{x}' THEN CASE WHEN pointer_x IS NOT NULL THEN 1.0 ELSE 0.0 END END) AS v{i}" for i, x in enumerate(("item_view", "search_results_view", "photo_swipe"))) + " FROM ev GROUP BY cookie_id)"
    far = "sqrt(pow(last(pointer_x ORDER BY event_ts, event_id) - first(pointer_x ORDER BY event_ts, event_id), 2) + pow(last(pointer_y ORDER BY event_ts, event_id) - first(pointer_y ORDER BY event_ts, event_id), 2))"
    places = "count(DISTINCT pointer_x * 10000 + pointer_y)"
    f = {"ptrd_step_q10": "quantile_cont(step, 0.1)", "ptrd_step_q50": "quantile_cont(step, 0.5)", "ptrd_step_q90": "quantile_cont(step, 0.9)", "ptrd_zero_step_share": "avg(CASE WHEN step IS NULL THEN NULL WHEN step = 0 THEN 1.0 ELSE 0.0 END)", "ptrd_path_len": "sum(step)"}
    f |= {"ptrd_turn_med": "quantile_cont(turn, 0.5)", "ptrd_turn_std": "stddev_samp(turn)", "ptrd_reversal_share": "avg(CASE WHEN turn IS NULL THEN NULL WHEN turn > pi() / 2 THEN 1.0 ELSE 0.0 END)", "ptrd_x_mod10": "avg(CASE WHEN pointer_x % 10 = 0 THEN 1.0 ELSE 0.0 END)", "ptrd_y_mod10": "avg(CASE WHEN pointer_y % 10 = 0 THEN 1.0 ELSE 0.0 END)"}
    f |= {"ptrd_edge_share": f"avg(CASE WHEN pointer_x <= 1 OR pointer_y <= 1 OR pointer_x >= {w - 1} OR pointer_y >= {h - 1} THEN 1.0 ELSE 0.0 END)", "ptrd_centre_dist_med": "quantile_cont(centre, 0.5)", "ptrd_centre_dist_std": "stddev_samp(centre)", "#ptrd_quadrants": "count(DISTINCT quadrant)", "ptrd_speed_q10": "quantile_cont(speed, 0.1)", "ptrd_speed_q90": "quantile_cont(speed, 0.9)", "ptrd_speed_std": "stddev_samp(speed)"}
    f |= {"ptrd_xy_corr": _corr("pointer_x", "pointer_y"), "ptrd_straightness": f"{far} / (sum(step) + 1)", "ptrd_bbox_fill": f"(max(pointer_x) - min(pointer_x)) * (max(pointer_y) - min(pointer_y)) / {float(w * h)}", "ptrd_repeat_share": f"1 - {places} / count(*)", "ptrd_step_entropy": "any_value(h1.h)", "ptrd_quadrant_entropy": "any_value(h2.h)"}
    f |= {f"ptrd_cover_{x}": f"any_value(v{i})" for i, x in enumerate(("item_view", "search_results_view", "photo_swipe"))}
    return _q(more, f, "FROM mv LEFT JOIN h1 USING (cookie_id) LEFT JOIN h2 USING (cookie_id) JOIN cv USING (cookie_id) GROUP BY cookie_id")


def _client() -> str:
    pick = lambda p: f"nullif(regexp_extract(user_agent, '{p}', 1), '')"
    scripts = "|".join((S.app_name, *C.SCRIPT_CLIENTS))
    more = f"""u0 AS (SELECT *, coalesce({pick(f'^({scripts})/')}, {pick('(' + '|'.join(C.BROWSERS) + ')')}, 'other') AS family, TRY_CAST({pick('^' + S.app_name + '/([0-9]+)')} AS BIGINT) AS av,
      TRY_CAST(coalesce({pick('Android ([0-9]+)')}, {pick('iOS ([0-9]+)')}) AS BIGINT) AS ov, TRY_CAST({pick('(?:Chrome|Firefox|Safari)/([0-9]+)')} AS BIGINT) AS bv, {pick('(?:Android [0-9]+; |iPhone; iOS [0-9.]+; )([^)]+)')} AS device FROM ev),
      u AS (SELECT *, CASE WHEN device IS NOT NULL THEN count(*) OVER (PARTITION BY device) / count(device) OVER () END AS df, count(*) OVER (PARTITION BY user_agent) AS uf FROM u0), {_entropy('h', 'platform')}"""
    share = lambda cond: f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"
    f = {f"plat_{p}": share(f"platform = '{p}'") for p in C.PLATFORMS} | {"#n_platforms": "count(DISTINCT platform)", "platform_entropy": "any_value(h.h)", "#n_user_agents": "count(DISTINCT user_agent)", "ua_headless_rate": share("contains(user_agent, 'Headless')"), "ua_mobile_rate": share("regexp_matches(user_agent, '(?i)Android|iPhone|Mobile')")}
    f |= {f'"uafam_{x}"': share(f"family = '{x}'") for x in (S.app_name, *C.SCRIPT_CLIENTS, *C.BROWSERS, "other")}
    f |= {"ua_script_rate": share("family IN (" + ", ".join(f"'{x}'" for x in C.SCRIPT_CLIENTS) + ")"), "#ua_app_version": "max(av)", "#ua_os_version": "max(ov)", "#ua_browser_version": "max(bv)", "ua_device_freq": "avg(df)", "#ua_freq_min": "min(uf)", "ua_freq_mean": "avg(uf)"}
    return _q(more, f, "FROM u JOIN h USING (cookie_id) GROUP BY cookie_id")


def _id_structure() -> str:
    f = {"idst_std": "stddev_samp(item_id)", "#idst_range": "max(item_id) - min(item_id)", "idst_iqr": "quantile_cont(item_id, 0.75) - quantile_cont(item_id, 0.25)", "idst_median": "quantile_cont(item_id, 0.5)", "idst_up_share": "avg(CASE WHEN step IS NULL THEN NULL WHEN step > 0 THEN 1.0 ELSE 0.0 END)", "idst_step_abs_med": "quantile_cont(abs(step), 0.5)"}
    f |= {"#idst_prefix_nuniq": "count(DISTINCT item_id // 1000)", "idst_range_per_item": "(max(item_id) - min(item_id)) / (count(DISTINCT item_id) + 1)"}
    return _q(f"it AS (SELECT *, item_id - lag(item_id) OVER ({_P}) AS step FROM ev WHERE item_id IS NOT NULL)", f, "FROM it GROUP BY cookie_id")


def _granularity() -> str:
    f = {"#dtg_nuniq": "count(*)", "dtg_uniq_frac": "count(*) / sum(c)", "#dtg_mode_count": "max(c)"} | {f"dtg_round{k}": f"sum(CASE WHEN dt % {k} = 0 THEN c ELSE 0 END) / sum(c)" for k in S.round_gaps}
    return _q("g AS (SELECT cookie_id, dt, count(*) AS c FROM ev WHERE dt IS NOT NULL GROUP BY 1, 2)", f, "FROM g GROUP BY cookie_id")


def _catalog() -> str:
    parts = []
    for c, k in S.catalog_tops:
        parts.append(f"SELECT cookie_id, '{c}' AS field, t.v AS value, CASE WHEN bool_or({c} IN (SELECT v FROM t_{c})) THEN round(count(*) FILTER ({c} = t.v) / count({c}), 6) END AS share FROM ev CROSS JOIN t_{c} t GROUP BY cookie_id, t.v")
    tops = ", ".join(f"t_{c} AS (SELECT {c} AS v FROM ev WHERE is_fit AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT {k})" for c, k in S.catalog_tops)
    return f"WITH {CLICKS}{_enriched()}, {tops} " + " UNION ALL ".join(parts)


def _pct(x: str, over: str) -> str:
    return f"(rank() OVER ({over} ORDER BY {x}) + (count(*) OVER ({over}{', ' if 'PARTITION' in over else 'PARTITION BY '}{x}) - 1) / 2.0) / count(*) OVER ({over})"


def _popularity() -> str:
    more = f"pr AS (SELECT cookie_id, item_id, count(*) AS own FROM ev WHERE item_id IS NOT NULL GROUP BY 1, 2), p1 AS (SELECT *, count(*) OVER (PARTITION BY item_id) - 1 AS others, sum(own) OVER (PARTITION BY item_id) - own AS other_views FROM pr), p2 AS (SELECT *, {_pct('others', '')} AS pct, {_pct('other_views', '')} AS vp FROM p1)"
    f = {"pop_pct_mean": "avg(pct)", "pop_pct_med": "quantile_cont(pct, 0.5)", "pop_pct_max": "max(pct)", "pop_pct_std": "stddev_samp(pct)", "pop_views_pct_mean": "avg(vp)", "pop_views_pct_std": "stddev_samp(vp)", "pop_solo_share": "avg(CASE WHEN others <= 0 THEN 1.0 ELSE 0.0 END)"}
    return _q(more, f, "FROM p2 GROUP BY cookie_id")


def _covisitation() -> str:
    more = """p AS (SELECT DISTINCT cookie_id, item_id FROM ev WHERE item_id IS NOT NULL), o AS (SELECT cookie_id, count(*) AS k FROM p GROUP BY 1),
      e AS (SELECT a.cookie_id, b.cookie_id AS w, count(*) AS n FROM p a JOIN p b ON a.item_id = b.item_id AND a.cookie_id <> b.cookie_id GROUP BY 1, 2),
      j AS (SELECT e.cookie_id, n, n / (x.k + y.k - n) AS j FROM e JOIN o x ON x.cookie_id = e.cookie_id JOIN o y ON y.cookie_id = w),
      g AS (SELECT cookie_id, count(*) AS deg, max(n) AS mx, CAST(sum(n) AS BIGINT) AS sm, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS rp, max(j) AS jm, avg(j) AS ja FROM j GROUP BY 1),
      h AS (SELECT o.cookie_id, coalesce(deg, 0) AS deg, mx, sm / deg AS mean, coalesce(sm, 0) AS sm, coalesce(deg, 0) / k AS per, rp, jm, ja FROM o LEFT JOIN g USING (cookie_id))"""
    f = {"#cv_degree": "deg", "#cv_shared_max": "mx", "cv_shared_mean": "mean", "#cv_shared_sum": "sm", "cv_deg_per_item": "per", "cv_repeat": "rp", "cv_jaccard_max": "jm", "cv_jaccard_mean": "ja"}
    f |= {"cv_degree_pct": _pct("deg", ""), "cv_deg_per_item_pct": _pct("per", ""), "cv_shared_mean_pct": f"CASE WHEN mean IS NOT NULL THEN {_pct('mean', 'PARTITION BY mean IS NULL')} END"}
    return _q(more, f, "FROM h")


def _shapes() -> str:
    from ..operators.shapes import CHANNELS

    sql = lambda e: e.replace("log1p(dt)", "ln(1 + dt)").replace("string(item_id % 100)", "CAST(item_id % 100 AS VARCHAR)").replace("string(hour(event_ts))", "CAST(hour(event_ts) AS VARCHAR)").replace("double(", "(").replace("0D", "0")
    rows = " UNION ALL ".join(f"SELECT '{c}' AS channel, cookie_id, is_fit, {sql(g)} AS grp, round(CAST({sql(v)} AS DOUBLE), 6) AS v FROM ev" for c, (g, v) in CHANNELS.items())
    more = f"""l AS (SELECT * FROM ({rows}) WHERE grp IS NOT NULL AND v IS NOT NULL),
      vs AS (SELECT channel, grp, v, count(*) FILTER (is_fit) AS fit FROM l GROUP BY 1, 2, 3),
      vb AS (SELECT channel, grp, v, coalesce(least(floor(24 * (sum(fit) OVER (PARTITION BY channel, grp ORDER BY v) - fit) / nullif(sum(fit) OVER (PARTITION BY channel, grp), 0)), 23), 0) AS bin FROM vs),
      lb AS (SELECT l.channel, l.cookie_id, l.grp, vb.bin, CASE WHEN l.is_fit THEN l.cookie_id % 5 ELSE -1 END AS fold, m.target AS y, l.is_fit FROM l JOIN vb USING (channel, grp, v) JOIN cookies m USING (cookie_id)),
      fo AS (SELECT DISTINCT fold FROM lb),
      ce AS (SELECT channel, grp, bin, fo.fold, count(*) FILTER (y = 1 AND b.fold <> fo.fold) AS pos, count(*) FILTER (y = 0 AND b.fold <> fo.fold) AS neg FROM (SELECT * FROM lb WHERE is_fit) b, fo GROUP BY 1, 2, 3, 4),
      ra AS (SELECT channel, grp, bin, fold, ln((pos + 1) / (sum(pos) OVER w + count(*) OVER w)) - ln((neg + 1) / (sum(neg) OVER w + count(*) OVER w)) AS r FROM ce WINDOW w AS (PARTITION BY channel, fold)),
      sc AS (SELECT lb.cookie_id, lb.channel, coalesce(r, 0) AS r FROM lb LEFT JOIN ra USING (channel, grp, bin, fold)),
      al AS (SELECT cookie_id, channel, avg(r) AS mean, stddev_pop(r) AS std, min(r) AS least, max(r) AS most, quantile_cont(r, 0.1) AS q10, quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.9) AS q90 FROM sc GROUP BY 1, 2
        UNION ALL SELECT cookie_id, 'total', sum(r) / any_value(n), NULL, NULL, NULL, NULL, NULL, NULL FROM sc JOIN (SELECT cookie_id, count(*) AS n FROM ev GROUP BY 1) USING (cookie_id) GROUP BY 1)"""
    return _q(more, {"$channel": "channel"} | {c: c for c in ("mean", "std", "least", "most", "q10", "q50", "q90")}, "FROM al")


def _drift() -> str:
    columns = ("n_events", "n_active_hours", "hour_entropy", "rate_item_view", "night_rate", "dt_q50", "dt_iqr")
    nine = lambda sql: sql.replace(" AS DOUBLE), 6) AS ", " AS DOUBLE), 9) AS ")
    rows = " UNION ALL ".join(f"SELECT '{c}' AS name, NOT is_fit AS b, round(CAST({c} AS DOUBLE), 9) AS v FROM f" for c in columns)
    more = f"f AS (SELECT * FROM ({nine(_volume())}) JOIN ({nine(_timing())}) USING (cookie_id) JOIN cookies USING (cookie_id)), l AS ({rows}), k AS (SELECT *, rank() OVER (PARTITION BY name, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY name, v) - 1) / 2.0 AS r FROM l)"
    known = lambda side: f"count(*) FILTER ({side} AND v IS NOT NULL)"
    f = {"$name": "name", "#n_a": known("NOT b"), "#n_b": known("b"), "auc": f"(sum(r) FILTER (b AND v IS NOT NULL) - {known('b')} * ({known('b')} + 1) / 2.0) / ({known('b')} * {known('NOT b')})"}
    f |= {f"missing_{s}": f"avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) FILTER ({e})" for s, e in (("a", "NOT b"), ("b", "b"))}
    return f"WITH {CLICKS}, {more} {_sel(f, '')} FROM k GROUP BY name"


def _crowd() -> str:
    more = """d AS (SELECT *, ln(1 + greatest(dwell, 0)) AS ld FROM ev WHERE dwell IS NOT NULL), du AS (SELECT event_name, quantile_cont(ld, 0.5) AS u FROM d WHERE is_fit GROUP BY 1),
      a AS (SELECT cookie_id, avg(ld - u) AS x, stddev_samp(ld - u) AS y, quantile_cont(ld - u, 0.5) AS z FROM d LEFT JOIN du USING (event_name) GROUP BY cookie_id),
      pu AS (SELECT search_query, quantile_cont(search_page, 0.5) AS u FROM ev WHERE is_fit AND search_page IS NOT NULL AND search_query IS NOT NULL GROUP BY 1), b AS (SELECT cookie_id, avg(search_page - u) AS x2, max(search_page - u) AS y2 FROM ev LEFT JOIN pu USING (search_query) WHERE search_page IS NOT NULL AND search_query IS NOT NULL GROUP BY cookie_id)"""
    return _q(more, {"crowd_dwell_mean": "x", "crowd_dwell_std": "y", "crowd_dwell_med": "z", "crowd_page_mean": "x2", "crowd_page_max": "y2"}, "FROM a FULL JOIN b USING (cookie_id)")


def _dwell() -> str:
    f = {}
    for x in C.DWELL_EVENTS:
        of = f"FILTER (event_name = '{x}')"
        f |= {f"dwell_{x}_med": f"quantile_cont(dwell, 0.5) {of}", f"dwell_{x}_mean": f"avg(dwell) {of}", f"dwell_{x}_std": f"stddev_samp(dwell) {of}"}
    f["dwell_item_vs_search"] = "quantile_cont(dwell, 0.5) FILTER (event_name = 'item_view') / (quantile_cont(dwell, 0.5) FILTER (event_name = 'search_results_view') + 1)"
    return _q("", f, "FROM ev WHERE dwell IS NOT NULL GROUP BY cookie_id")


def _navigation(where: str = "TRUE", prefix: str = "") -> str:
    ctes, joins, f = [], [], {}
    item = f"({_cnt('item_view')} + 1)"
    f |= {"funnel_items_per_search": f"{_cnt('item_view')} / ({_cnt('search_results_view')} + 1)", "funnel_contact_per_item": f"count(*) FILTER ({_in(C.CONTACT)}) / {item}", "funnel_seller_per_item": f"{_cnt('seller_page_view')} / {item}", "funnel_swipe_per_item": f"{_cnt('photo_swipe')} / {item}"}
    for c, short in (("item_category", "cat"), ("item_location", "loc"), ("search_query", "query")):
        ctes.append(f"n{short}0 AS (SELECT *, lag({c}) OVER ({_P}) AS b FROM ev WHERE {c} IS NOT NULL), n{short}1 AS (SELECT *, CASE WHEN {c} <> b THEN 1 ELSE 0 END AS ch FROM n{short}0 WHERE b IS NOT NULL), n{short}2 AS (SELECT *, sum(ch) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM n{short}1), n{short} AS (SELECT cookie_id, sum(c) / sum(n) AS sw, avg(n) AS rm, max(n) AS rx FROM (SELECT cookie_id, g, count(*) AS n, sum(ch) AS c FROM n{short}2 GROUP BY 1, 2) GROUP BY 1)")
        joins.append(f"LEFT JOIN n{short} USING (cookie_id)")
        f |= {f"nav_{short}_switch_rate": f"any_value(n{short}.sw)", f"nav_{short}_run_mean": f"any_value(n{short}.rm)", f"#nav_{short}_run_max": f"any_value(n{short}.rx)"}
    ctes += [_islands("sw", "ev", "event_name = 'photo_swipe'"), "rv AS (SELECT cookie_id, max(n) AS n FROM (SELECT cookie_id, item_id, count(*) AS n FROM ev WHERE item_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"]
    f |= {"#swipe_run_max": "coalesce(any_value(sw.n), 0)", "#item_revisit_max": "any_value(rv.n)"}
    f = {(n[0] + prefix + n[1:] if n[0] == "#" else prefix + n): e for n, e in f.items()}
    return _q(", ".join(ctes), f, f"FROM ev {' '.join(joins)} LEFT JOIN sw USING (cookie_id) LEFT JOIN rv USING (cookie_id) GROUP BY cookie_id", where)


def _bins(width: int, p: str) -> str:
    more = f"b0 AS (SELECT cookie_id, (sec - min(sec) OVER (PARTITION BY cookie_id)) // {width} AS bin FROM ev), b1 AS (SELECT cookie_id, bin, count(*) AS c FROM b0 GROUP BY 1, 2), b2 AS (SELECT *, greatest(bin - lag(bin) OVER (PARTITION BY cookie_id ORDER BY bin) - 1, 0) AS off, bin - row_number() OVER (PARTITION BY cookie_id ORDER BY bin) AS g FROM b1), o AS (SELECT cookie_id, max(n) AS n FROM (SELECT cookie_id, g, count(*) AS n FROM b2 GROUP BY 1, 2) GROUP BY 1)"
    f = {f"#{p}_max": "max(c)", f"{p}_mean": "avg(c)", f"{p}_fano": "var_samp(c) / avg(c)", f"{p}_occupancy": "count(*) / (max(bin) + 1)", f"{p}_entropy": "ln(sum(c)) - sum(c * ln(c)) / sum(c)", f"{p}_peak_share": "max(c) / sum(c)", f"#{p}_run_off": "coalesce(max(CASE WHEN off IS NOT NULL THEN off END), 0)", f"#{p}_run_on": "any_value(o.n)"}
    return _q(more, f, "FROM b2 JOIN o USING (cookie_id) GROUP BY cookie_id")


def _irregular() -> str:
    day = "2 * pi() * (sec % 86400) / 86400.0"
    more = f"""t AS (SELECT cookie_id, count(*) AS n, avg(cos({day})) AS c, avg(sin({day})) AS d FROM ev GROUP BY 1),
      md AS (SELECT cookie_id, dt AS modal FROM (SELECT cookie_id, dt, row_number() OVER (PARTITION BY cookie_id ORDER BY count(*) DESC, dt) AS k FROM ev WHERE dt IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
      gl AS (SELECT cookie_id, stddev_samp(ln(1 + dt)) AS s, quantile_cont(ln(1 + dt), 0.75) - quantile_cont(ln(1 + dt), 0.25) AS i, avg(CASE WHEN abs(dt - modal) <= 1 THEN 1.0 ELSE 0.0 END) AS m FROM ev JOIN md USING (cookie_id) WHERE dt IS NOT NULL GROUP BY 1),
      pe AS (SELECT cookie_id, CASE WHEN sum(c) >= 2 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(6) END AS h FROM (SELECT cookie_id, CASE WHEN dt_third <= dt_before THEN CASE WHEN dt_before <= dt THEN 'abc' WHEN dt_third <= dt THEN 'acb' ELSE 'cab' END ELSE CASE WHEN dt_third <= dt THEN 'bac' WHEN dt_before <= dt THEN 'bca' ELSE 'cba' END END AS shape, count(*) AS c FROM ev WHERE dt_third IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
    f = {"tod_resultant": "sqrt(c * c + d * d)", "tod_rayleigh": "n * (c * c + d * d)", "gap_log_std": "gl.s", "gap_log_iqr": "gl.i", "gap_near_mode": "gl.m", "gap_perm_entropy": "pe.h"}
    return _q(more, f, "FROM t LEFT JOIN gl USING (cookie_id) LEFT JOIN pe USING (cookie_id)")


def _stated() -> str:
    """The compared columns to six digits beside their ranks."""
    return _relative(True)


def _relative(with_base: bool = False) -> str:
    """Each base column from the SQL of its own family, to nine digits."""
    plat = tuple(f"plat_{p}" for p in C.PLATFORMS)
    sources = {
        _volume(): ("n_events", "rate_item_view", "rate_engagement"),
        _timing(): ("dt_q50", "dt_iqr", "events_per_h"),
        _granularity(): ("dtg_uniq_frac",),
        _sessions(): ("sess_events_mean",),
        _content(): ("item_location_nuniq", "item_category_nuniq", "item_id_nuniq"),
        _pagination(): ("page_mean", "page_max"),
        _navigation(): ("funnel_items_per_search", "nav_loc_switch_rate"),
        _pointer("platform IN ('web', 'desktop')", "webp_"): ("webp_pointer_coverage",),
        _dwell(): ("dwell_item_view_med",),
        _pointer_deep(): ("ptrd_straightness",),
        _id_structure(): ("idst_range",),
        _client(): ("ua_freq_mean", *plat),
    }
    names = [c for columns in sources.values() for c in columns if c not in plat]
    parts = [f"(SELECT cookie_id, {', '.join(columns)} FROM ({sql.replace(' AS DOUBLE), 6) AS ', ' AS DOUBLE), 9) AS ')}))" for sql, columns in sources.items()]
    more = f"""fx AS (SELECT *, CASE greatest({', '.join(plat)}) {' '.join(f"WHEN plat_{p} THEN '{p}'" for p in C.PLATFORMS)} END AS pf FROM {' LEFT JOIN '.join(f'{part} s{i} USING (cookie_id)' if i else part + ' s0' for i, part in enumerate(parts))}),
      fp AS (SELECT fx.*, m.is_fit AS fit FROM fx JOIN cookies m USING (cookie_id))"""
    f = {"#dominant_platform": "CASE pf WHEN 'android' THEN 0 WHEN 'desktop' THEN 1 WHEN 'ios' THEN 2 ELSE 3 END"}
    fit = lambda c, order: f"sum(CASE WHEN fit THEN 1 ELSE 0 END) OVER (PARTITION BY pf, {c} IS NULL{order})"
    f |= {f"rel_plat_{c}": f"CASE WHEN {c} IS NOT NULL AND pf IS NOT NULL THEN {fit(c, f' ORDER BY {c}')} / nullif({fit(c, '')}, 0) END" for c in names}
    if with_base:
        whole = ("n_events", "item_location_nuniq", "item_category_nuniq", "item_id_nuniq", "page_max", "idst_range")
        f |= {(f"#{c}" if c in whole else c): c for c in names}
    return f"WITH {CLICKS}, {more} {_sel(f)} FROM fp a"


_SCORED = """sc AS (SELECT d.doc_id AS id, CAST(l.toxic AS BIGINT) AS y, floor(d.n_chars / 200.0) AS s, floor(d.n_chars / 1000.0) % 7 AS s2, d.lang, CAST(d.n_chars AS DOUBLE) AS n_chars FROM documents d JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
g AS (SELECT {by} s, sum(y) AS pos, count(*) AS n FROM sc {where} GROUP BY {by} s),
cv AS (SELECT *, sum(pos) OVER ({part} ORDER BY s DESC) AS tp, sum(n) OVER ({part} ORDER BY s DESC) AS seen, sum(pos) OVER ({part}) AS np, sum(n) OVER ({part}) AS na FROM g)"""
_METRICS = {
    "p_at_r": "CASE WHEN max(np) > 0 THEN coalesce(max(CASE WHEN tp / np >= 0.7 THEN tp / seen END), 0) END",
    "roc_auc": "sum(pos * ((na - np) - (seen - tp) + (n - pos) / 2.0)) / nullif(max(np) * (max(na) - max(np)), 0)",
    "average_precision": "sum(pos * tp / seen) / nullif(max(np), 0)",
    "recall_at_fpr": "CASE WHEN max(np) > 0 THEN coalesce(max(CASE WHEN seen - tp <= 0.01 * (na - np) THEN tp / np END), 0) END",
}


def _agreement() -> str:
    from .queries import MODELS

    rows = " UNION ALL ".join(f"SELECT '{m}' AS model, id, y, CAST({e} AS DOUBLE) AS v FROM sc" for m, e in MODELS.items())
    part = "PARTITION BY model, split, h"
    return f"""{_scored()}, mo AS ({rows}),
      dr AS (SELECT model, split, ('0x' || substr(md5('42:' || split || ':' || id), 1, 8))::BIGINT / 4294967296.0 >= 0.5 AS h, v, sum(y) AS pos, count(*) AS n FROM mo, range(60) r(split) GROUP BY 1, 2, 3, 4),
      dc AS (SELECT *, sum(pos) OVER ({part} ORDER BY v DESC) AS tp, sum(n) OVER ({part} ORDER BY v DESC) AS seen, sum(pos) OVER ({part}) AS np, sum(n) OVER ({part}) AS na FROM dr),
      me AS (SELECT model, split, h, {', '.join(f'{e} AS {n}' for n, e in _METRICS.items())} FROM dc GROUP BY 1, 2, 3),
      un AS (SELECT model, split, name AS surrogate, v AS a FROM (UNPIVOT (SELECT * FROM me WHERE NOT h) ON {', '.join(_METRICS)} INTO NAME name VALUE v)),
      bo AS (SELECT un.model, un.split, surrogate, round(a, 12) AS a, round(p_at_r, 12) AS b FROM un JOIN me ON me.h AND me.model = un.model AND me.split = un.split WHERE p_at_r IS NOT NULL),
      rk AS (SELECT surrogate, split, {_pct('a', 'PARTITION BY surrogate, split')} AS ra, {_pct('b', 'PARTITION BY surrogate, split')} AS rb FROM bo),
      co AS (SELECT surrogate, split, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS r FROM rk GROUP BY 1, 2)
      SELECT surrogate, count(r) AS n_splits, round(avg(r), 6) AS agreement, 'p_at_r' AS target FROM co GROUP BY 1"""


def _scored(by: str = "", where: str = "") -> str:
    return "WITH " + _SCORED.format(by=f"{by}, " if by else "", part=f"PARTITION BY {by}" if by else "", where=where)


def _metric(*names: str) -> str:
    return f"{_scored()} {_sel({n: _METRICS[n] for n in names}, '')} FROM cv"


def _keys() -> str:
    more, cols = [], []
    for c, n in (("user_agent", "key_ua"), ("item_category", "key_category"), ("item_location", "key_location")):
        more.append(f"{n} AS (SELECT cookie_id, {c} AS v FROM (SELECT cookie_id, {c}, row_number() OVER (PARTITION BY cookie_id ORDER BY count(*) DESC, {c}) AS k FROM ev WHERE {c} IS NOT NULL GROUP BY 1, 2) WHERE k = 1)")
        cols.append((n, f"coalesce({n}.v, '?')"))
    return _q(", ".join(more), {f"${n}": e for n, e in cols}, "FROM cookies LEFT JOIN key_ua USING (cookie_id) LEFT JOIN key_category USING (cookie_id) LEFT JOIN key_location USING (cookie_id)", key="$cookies.cookie_id")


_KEYED = "kd AS (SELECT m.cookie_id, m.target AS y, m.is_fit, m.cookie_id % 5 AS fold, 'h' || ((m.cookie_id * 7) % 9) AS k FROM cookies m)"
_SM = S.smoothing


def _encoding() -> str:
    more = f"{_KEYED}, pr AS (SELECT avg(y) AS p FROM kd WHERE is_fit), rt AS (SELECT k, (sum(y) + {_SM} * (SELECT p FROM pr)) / (count(*) + {_SM}) AS r FROM kd WHERE is_fit GROUP BY k)"
    return _q(more, {"rate": "coalesce(r, (SELECT p FROM pr))"}, "FROM kd LEFT JOIN rt USING (k)")


def _encoding_oof() -> str:
    more = f"{_KEYED}, a AS (SELECT x.cookie_id, x.fold, (SELECT avg(y) FROM kd o WHERE o.fold <> x.fold) AS p, (SELECT coalesce(sum(y), 0) FROM kd o WHERE o.fold <> x.fold AND o.k = x.k) AS s, (SELECT count(*) FROM kd o WHERE o.fold <> x.fold AND o.k = x.k) AS n FROM kd x)"
    return _q(more, {"#fold": "fold", "rate": f"(s + {_SM} * p) / (n + {_SM})"}, "FROM a")


def _checks() -> str:
    more = """wanted AS (SELECT cookie_id FROM cookies WHERE NOT is_fit), scores AS (SELECT cookie_id, cookie_id / (cookie_id + 1000.0) AS s FROM wanted),
      told AS (SELECT count(*) AS n_rows, count(DISTINCT cookie_id) AS n_ids, count(DISTINCT s) AS n_scores, count(*) FILTER (s IS NULL OR isnan(s)) AS n_missing, count(*) FILTER (s < 0 OR s > 1) AS n_outside FROM scores),
      more AS (SELECT count(*) AS n_extra FROM scores ANTI JOIN wanted USING (cookie_id)), less AS (SELECT count(*) AS n_absent FROM wanted ANTI JOIN scores USING (cookie_id))"""
    passes = "n_rows = n_ids AND n_missing = 0 AND n_outside = 0 AND n_extra = 0 AND n_absent = 0 AND n_scores > 0.9 * n_rows"
    return f"WITH {CLICKS}, {more} SELECT *, {passes} AS passes FROM told, more, less"


def _duplicates() -> str:
    columns = {"n_events": "n_events", "n_active_hours": "n_active_hours", "hour_entropy": "hour_entropy", "a_copy": "n_events", "n_hours_copy": "n_active_hours"}
    rows = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    pairs = [(a, b, i) for i, a in enumerate(columns) for b in list(columns)[i + 1 :]]
    same = " UNION ALL ".join(f"SELECT '{b}' AS name, '{a}' AS f, {i} AS k, bool_and({a} IS NOT DISTINCT FROM {b}) AS same FROM v" for a, b, i in pairs)
    return f"WITH v AS (SELECT {rows} FROM ({_volume()})) SELECT name, arg_min(f, k) AS first FROM ({same}) WHERE same GROUP BY name"


def oracles() -> dict[str, str]:
    web, mobile = "platform IN ('web', 'desktop')", "platform IN ('android', 'ios')"
    base = f"WITH {CLICKS} "
    out = {
        "clip_window": base + "SELECT cookie_id, count(*) AS n_events, min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM ev0 GROUP BY cookie_id",
        "platform_norm": base + "SELECT platform, count(*) AS n FROM (SELECT CASE WHEN lower(raw_platform) = 'iphone' THEN 'ios' ELSE lower(raw_platform) END AS platform FROM clicks) GROUP BY platform",
        "late_share": base + "SELECT count(*) AS n_events, round(avg(CASE WHEN event_ts < window_start_ts THEN 1.0 ELSE 0.0 END), 6) AS early_share, round(avg(CASE WHEN event_ts > window_end_ts THEN 1.0 ELSE 0.0 END), 6) AS late_share, round(avg(CASE WHEN event_ts >= window_start_ts AND event_ts < window_end_ts THEN 1.0 ELSE 0.0 END), 6) AS kept_share FROM clicks JOIN cookies USING (cookie_id)",
        "b01_volume_mix": _volume(),
        "top_bigrams": f"WITH {CLICKS}{_enriched()}, {_TOP} SELECT pair, n FROM top",
        "b02_transitions": _transitions(),
        "b03_timing": _timing(),
        "b04_sessions": _sessions(),
        "b05_content": _content(),
        "b06_pagination": _pagination(),
        "b07_pointer": _pointer(),
        "b08_client": _client(),
        "b09_id_structure": _id_structure(),
        "b10_dt_granularity": _granularity(),
        "b11_catalog_shares": _catalog(),
        "b12_popularity": _popularity(),
        "b13_crowd": _crowd(),
        "b14_dwell": _dwell(),
        "b15_navigation": _navigation(),
        "b16_pointer_web": _pointer(web, "webp_"),
        "b17_pointer_deep": _pointer_deep(),
        "b18_mobile_timing": _timing(mobile, "mob_"),
        "b18_mobile_navigation": _navigation(mobile, "mob_"),
        "b19_web_timing": _timing(web, "web_"),
        **{f"b20_bins_{i}": _bins(w, n) for i, (w, n) in enumerate(zip(S.bin_widths, S.bin_names), 1)},
        "b20_irregular": _irregular(),
        "b21_coverage": _q("", {"first_event_offset_h": "(min(sec) - epoch(any_value(window_start_ts))) / 3600.0", "last_event_offset_h": "(epoch(any_value(window_end_ts)) - max(sec)) / 3600.0", "window_coverage": "(max(sec) - min(sec)) / 3600.0 / 24"}, "FROM ev JOIN cookies USING (cookie_id) GROUP BY cookie_id"),
        "b23_cookie_meta": base + _sel({"cookie_age_days": "epoch(window_start_ts - cookie_created_at) / 86400.0", "cookie_age_log": "ln(1 + greatest(epoch(window_start_ts - cookie_created_at) / 86400.0, 0))", "#cookie_created_hour": "hour(cookie_created_at)", "#cookie_created_dow": "isodow(cookie_created_at) - 1", "#window_dow": "isodow(window_start_ts) - 1"}) + " FROM cookies",
        "b24_relative": _relative(),
        "b25_covisitation": _covisitation(),
        "b26_class_shapes": _shapes(),
        "column_drift": _drift(),
        "feature_matrix_stated": _stated(),
        "dominant_keys": _keys(),
        "target_encoding": _encoding(),
        "target_encoding_oof": _encoding_oof(),
        "target_encoding_ordered": _q(
            f"{_KEYED}, pm AS (SELECT cookie_id, k, y, perm, md5('42:' || perm || ':' || cookie_id) AS o FROM kd, range(4) r(perm) WHERE is_fit), rn AS (SELECT cookie_id, (sum(y) OVER w - y + 0.5) / (count(*) OVER w) AS r FROM pm WINDOW w AS (PARTITION BY perm, k ORDER BY o, cookie_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), al AS (SELECT k, sum(y) AS p, count(*) AS n FROM kd WHERE is_fit GROUP BY k), ot AS (SELECT cookie_id, avg(r) AS rate FROM rn GROUP BY 1 UNION ALL SELECT cookie_id, (coalesce(p, 0) + 0.5) / (coalesce(n, 0) + 1) FROM kd LEFT JOIN al USING (k) WHERE NOT is_fit)",
            {"rate": "rate"}, "FROM ot",
        ),
        "pr_curve": f"{_scored()} {_sel({'s': 's', '#tp': 'tp', '#fp': 'seen - tp', 'precision': 'tp / seen', 'recall': 'tp / np'}, '')} FROM cv",
        "p_at_r70": _metric("p_at_r"),
        "recall_at_fpr": _metric("recall_at_fpr"),
        "roc_auc": _metric("roc_auc"),
        "average_precision": _metric("average_precision"),
        "score_bundle": _metric(*_METRICS),
        "rank_average": f"{_scored()}, u AS (SELECT id, 'a' AS bag, s AS v, 2.0 AS w FROM sc UNION ALL SELECT id, 'b', s2, 1.0 FROM sc), r AS (SELECT *, {_pct('v', 'PARTITION BY bag')} AS p FROM u) SELECT id, round(sum(p * w) / sum(w), 6) AS score FROM r GROUP BY id",
        "minmax_rescale": f"{_scored()} SELECT id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 6) AS score FROM sc",
        "blend_weights": f"{_scored()}, gr AS (SELECT a, b FROM range(5) x(a), range(5) y(b) WHERE a + b > 0), bl AS (SELECT a, b, y, round((a * (s / 100) + b * (s2 / 7)) / (a + b), 9) AS v FROM sc, gr), bg AS (SELECT a, b, v, sum(y) AS pos, count(*) AS n FROM bl GROUP BY 1, 2, 3), bc AS (SELECT *, sum(pos) OVER (PARTITION BY a, b ORDER BY v DESC) AS tp, sum(n) OVER (PARTITION BY a, b ORDER BY v DESC) AS seen, sum(pos) OVER (PARTITION BY a, b) AS np FROM bg) SELECT a AS w_one, b AS w_two, round(round(sum(pos * tp / seen) / max(np), 9), 6) AS ap FROM bc GROUP BY a, b ORDER BY round(sum(pos * tp / seen) / max(np), 9) DESC, a, b LIMIT 1",
        "regime_slices": " UNION ALL ".join(f"SELECT * FROM ({_scored('', w)} {_sel({'$regime': repr(n), '#n_pos': 'sum(pos)', '#n': 'sum(n)'} | _METRICS, '')} FROM cv HAVING sum(pos) >= 5)" for n, w in (("all", ""), ("english", "WHERE lang = 'en'"), ("other", "WHERE lang <> 'en'"), ("long", "WHERE n_chars > 3000"))),
        "caught_vs_missed": f"{_scored()}, ct AS (SELECT max(s) AS cut FROM cv WHERE tp / np >= 0.7), lo AS (SELECT y, s >= cut AS c, f.name, f.v FROM sc, ct, LATERAL (SELECT unnest([{{'name': 'n_chars', 'v': n_chars}}, {{'name': 's2', 'v': s2}}, {{'name': 's', 'v': s}}]) AS f)), ag AS (SELECT name AS feature, avg(v) FILTER (y = 1 AND c) AS cm, avg(v) FILTER (y = 1 AND NOT c) AS mm, avg(v) FILTER (y <> 1) AS om FROM lo GROUP BY name) SELECT feature, round(cm, 6) AS caught_mean, round(mm, 6) AS missed_mean, round(om, 6) AS other_mean, round(abs(mm - cm) / (abs(cm) + 1e-6), 6) AS gap FROM ag",
        "reliability": f"{_scored()} SELECT CAST(least(floor(n_chars / (n_chars + 1000) * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(n_chars / (n_chars + 1000)), 6) AS mean_score, round(avg(y), 6) AS positive_rate FROM sc GROUP BY 1",
        "likelihood_ratios": f"{_scored()}, bi AS (SELECT CAST((n_chars >= 500)::INT + (n_chars >= 1000)::INT + (n_chars >= 2000)::INT + (n_chars >= 5000)::INT AS BIGINT) AS bin, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM sc GROUP BY 1) SELECT bin, pos, neg, CASE WHEN neg > 0 THEN round(pos * (sum(neg) OVER ())::DOUBLE / (neg * (sum(pos) OVER ())::DOUBLE), 6) END AS ratio FROM bi",
        "prevalence_resample": f"{_scored()}, pq AS (SELECT sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q FROM sc) SELECT id, y FROM sc, pq WHERE ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT / 4294967296.0 < CASE WHEN y = 1 THEN q * 0.2 / (p * 0.8) ELSE p * 0.8 / (q * 0.2) END",
        "draw_spread": f"{_scored()}, dr AS (SELECT draw, s, sum(y) AS pos, count(*) AS n FROM sc, range(20) r(draw) WHERE ('0x' || substr(md5('42:' || draw || ':' || id), 1, 8))::BIGINT / 4294967296.0 < 0.5 GROUP BY 1, 2), dc AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY draw) AS np FROM dr WINDOW w AS (PARTITION BY draw ORDER BY s DESC)), da AS (SELECT draw, sum(pos * tp / seen) / nullif(max(np), 0) AS ap FROM dc GROUP BY draw) SELECT count(ap) AS n_draws, round(avg(ap), 6) AS ap_mean, round(stddev_samp(ap), 6) AS ap_std FROM da",
        "surrogate_agreement": _agreement(),
        "subgroup_reorder": f"{_scored()}, q AS (SELECT id, s, s2 FROM sc WHERE lang <> 'en'), bl AS (SELECT id, s, round(0.5 * ({_pct('s', '')}) + 0.5 * ({_pct('s2', '')}), 12) AS b FROM q), v AS (SELECT row_number() OVER (ORDER BY s, id) AS k, s AS new FROM bl), o AS (SELECT id, row_number() OVER (ORDER BY b, id) AS k FROM bl) SELECT sc.id, round(coalesce(v.new, sc.s), 6) AS score FROM sc LEFT JOIN o USING (id) LEFT JOIN v USING (k)",
        "fold_spread": f"{_scored().replace('d.lang', 'd.lang, d.doc_id % 5 AS fold', 1)}, fg AS (SELECT fold, s, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1, 2), fc AS (SELECT *, sum(pos) OVER (PARTITION BY fold ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY fold ORDER BY s DESC) AS seen, sum(pos) OVER (PARTITION BY fold) AS np, sum(n) OVER (PARTITION BY fold) AS na FROM fg), fm AS (SELECT fold, {', '.join(f'{e} AS {n}' for n, e in _METRICS.items())} FROM fc GROUP BY fold) SELECT name, count(v) AS n_groups, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS deviation, round(min(v), 6) AS least, round(max(v), 6) AS most FROM (UNPIVOT fm ON {', '.join(_METRICS)} INTO NAME name VALUE v) GROUP BY name",
        "subgroup_columns": base + " SELECT name, round(cover, 6) AS cover, n_values FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) / count(*) AS cover, count(DISTINCT {c}) AS n_values FROM ev0 WHERE platform IN ('android', 'ios')" for c in ("item_id", "search_page", "pointer_x", "seller_type", "platform")) + ") WHERE cover >= 0.02 AND n_values > 1",
        "forward_chain_splits": base + "SELECT d.day, CASE WHEN day_index < d.day THEN 'train' ELSE 'valid' END AS role, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_pos FROM cookies JOIN (SELECT day_index AS day, row_number() OVER (ORDER BY day_index) AS k FROM (SELECT DISTINCT day_index FROM cookies)) d ON day_index <= d.day WHERE d.k > 2 GROUP BY 1, 2",
        "stratified_folds": base + "SELECT cookie_id, CAST(target AS BIGINT) AS target, CAST((row_number() OVER (PARTITION BY target ORDER BY md5('42:' || cookie_id), cookie_id) - 1) % 5 AS BIGINT) AS fold FROM cookies",
        "strict_split": base + "SELECT day_index < 4 AS is_fit, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_pos FROM cookies GROUP BY 1",
        "recency_weights": base + "SELECT cookie_id, round(pow(0.5, ((SELECT max(day_index) FROM cookies) - day_index) / 3.0), 6) AS weight FROM cookies",
        "submission_checks": _checks(),
        "eda_value_counts": base + "SELECT event_name AS value, count(*) AS n FROM clicks GROUP BY 1",
        "eda_missing": base + " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM clicks" for c in ("item_id", "search_page", "pointer_x", "seller_type")),
        "eda_portrait": base + ", fx AS (SELECT cookie_id, any_value(target) AS target, count(*) AS n_events, avg(CASE WHEN pointer_x IS NOT NULL THEN 1.0 ELSE 0.0 END) AS pointer_coverage, count(DISTINCT item_id) AS n_items FROM ev0 GROUP BY cookie_id) " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}) FILTER (target = 0), 6) AS mean_0, round(avg({c}) FILTER (target = 1), 6) AS mean_1 FROM fx" for c in ("n_events", "pointer_coverage", "n_items")),
        "windows_per_day": base + "SELECT strftime(window_start_ts, '%Y-%m-%d') AS day, is_fit, count(*) AS n, CAST(sum(target) AS BIGINT) AS n_pos FROM cookies GROUP BY 1, 2",
        "basic_features": base + "SELECT m.cookie_id, coalesce(n, 0) AS n_events, coalesce(i, 0) AS n_items FROM cookies m LEFT JOIN (SELECT cookie_id, count(*) AS n, count(DISTINCT item_id) AS i FROM ev0 GROUP BY 1) USING (cookie_id)",
        "dedup_keep_first": base + "SELECT cookie_id, event_id FROM (SELECT cookie_id, event_id, row_number() OVER (PARTITION BY cookie_id ORDER BY event_id) AS k FROM clicks) WHERE k = 1",
        "dedup_keep_last": base + "SELECT cookie_id, event_id FROM (SELECT cookie_id, event_id, row_number() OVER (PARTITION BY cookie_id ORDER BY event_id DESC) AS k FROM clicks) WHERE k = 1",
        "set_ops": base + "SELECT count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS either FROM (SELECT is_fit AS a, target = 1 AS b FROM cookies)",
        "dup_columns": _duplicates(),
        "url_parts": "SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS host, count(*) AS n, count(*) FILTER (contains(url, 'utm_')) AS n_tracked FROM pages GROUP BY 1",
        "top_customers": "SELECT n_name AS nation, c_custkey, round(total, 2) AS total FROM (SELECT n_name, c_custkey, sum(o_totalprice) AS total, row_number() OVER (PARTITION BY n_name ORDER BY sum(o_totalprice) DESC, c_custkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE k <= 3",
    }
    return out
