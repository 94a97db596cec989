"""The feature families: each takes the enriched events of its row scope and gives one row per visitor.

All read one frame that is already partitioned by visitor, so the aggregations below need no exchange of their own;
only population statistics (popularity, user-agent frequency, percentiles, vocabularies) shuffle on other keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import Settings
from ..functions.kernels import KEY, ORDER, by_time, corr, derive, div, merge, ref, rounded, running, runs, seconds, share, summarise, value_counts
from ..functions.storage import written


def _names(xs: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def volume_and_mix(ev: DataFrame, s: Settings) -> DataFrame:
    facts = {"n_events": "count(*)"} | {f"cnt_{x}": f"count_if(event_name = '{x}')" for x in C.EVENT_NAMES}
    facts |= {"night_rate": "avg(double(hour(event_ts) BETWEEN 1 AND 5))"}
    hours = derive(value_counts(ev, {"hour": "hour(event_ts)"}), {"n_active_hours": "hour_u", "hour_entropy": "hour_h"})
    out = merge(summarise(ev, facts), hours)
    rate = {f"rate_{x}": div(f"cnt_{x}", "n_events") for x in C.EVENT_NAMES}
    out = out.withColumns(rate)
    return out.withColumns(
        {
            "n_events_log": F.log1p("n_events"),
            "rate_engagement": F.expr("+".join(f"rate_{x}" for x in C.ENGAGEMENT)),
            "rate_contact": F.expr("+".join(f"rate_{x}" for x in C.CONTACT)),
            "ratio_search_item": div("cnt_search_results_view", "cnt_item_view + 1"),
            "ratio_photo_item": div("cnt_photo_swipe", "cnt_item_view + 1"),
            "events_per_active_hour": div("n_events", "n_active_hours"),
        }
    ).withColumn("ratio_contact_seller", F.expr("rate_contact / (rate_seller_page_view + 0.01D)"))


def _pairs(ev: DataFrame) -> DataFrame:
    return ev.where("prev_name IS NOT NULL").withColumn("pair", F.concat_ws(">", "prev_name", "event_name"))


def top_bigrams(ev: DataFrame, s: Settings) -> DataFrame:
    """The most frequent transitions of fit visitors, by count and then by name. ``ev`` has ``is_fit``."""
    return _pairs(ev.where("is_fit")).groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(s.top_bigrams)


def transitions(ev: DataFrame, s: Settings, vocabulary: list[str]) -> DataFrame:
    pair = F.when(F.col("prev_name").isNotNull(), F.concat_ws(">", "prev_name", "event_name"))
    shares = [share(pair == F.lit(x)).alias(f"bg_{x}") for x in vocabulary]
    told = ev.groupBy(KEY).agg(F.expr("avg(double(prev_name = event_name))").alias("self_loop_rate"), *shares)
    pairs = value_counts(ev, {"pair": "CASE WHEN prev_name IS NOT NULL THEN concat_ws('>', prev_name, event_name) END"})
    return merge(told, derive(pairs, {"n_bigrams_uniq": "pair_u", "bigram_entropy": "pair_h"})).na.fill(0, ["n_bigrams_uniq"])


def timing(ev: DataFrame, s: Settings) -> DataFrame:
    gaps = ev.where("dt IS NOT NULL").withColumn("mid", F.expr(f"percentile(dt, 0.5) OVER (PARTITION BY {KEY})"))
    facts = {f"dt_q{int(q * 100)}": f"percentile(dt, {q})" for q in (0.1, 0.25, 0.5, 0.75, 0.9)}
    facts |= {"dt_min": "min(dt)", "dt_max": "max(dt)", "dt_mean": "avg(dt)", "dt_std": "stddev_samp(double(dt))", "dt_mad": "percentile(abs(dt - mid), 0.5)"}
    facts |= {f"dt_lt{k}": f"avg(double(dt < {k}))" for k in s.fast_gaps}
    out = gaps.groupBy(KEY).agg(*(F.expr(e).alias(n) for n, e in facts.items()), corr("dt", "dt_before").alias("dt_autocorr1"))
    out = out.withColumns(
        {
            "dt_iqr": F.expr("dt_q75 - dt_q25"),
            "dt_cv": F.expr("dt_std / (dt_mean + 1)"),
            "dt_burstiness": F.expr("(dt_std - dt_mean) / (dt_std + dt_mean + 1)"),
            "dt_fano": F.expr("dt_std * dt_std / (dt_mean + 1)"),
            "dt_rel_iqr": F.expr("(dt_q75 - dt_q25) / (dt_q50 + 1)"),
        }
    )
    spread = derive(value_counts(gaps, {"bucket": "bucket"}), {"dt_log_entropy": "bucket_h", "dt_mode_share": "bucket_top / bucket_n"})
    span = summarise(ev, {"n": "count(*)", "span_h": "(max(sec) - min(sec)) / 3600D"})
    span = derive(span, {"span_h": "span_h", "events_per_h": "n / greatest(span_h, 1 / 60D)"})
    return merge(span, out, spread)


def sessions(ev: DataFrame, s: Settings) -> DataFrame:
    each = ev.groupBy(KEY, "sess").agg(F.count("*").alias("n"), F.min("sec").alias("a"), F.max("sec").alias("b"))
    each = each.withColumn("gap", F.col("a") - F.lag("a").over(Window.partitionBy(KEY).orderBy("sess"))).withColumn("dur", F.expr("b - a"))
    return summarise(
        each,
        {
            "n_sessions": "count(*)", "sess_events_mean": "avg(n)", "sess_events_max": "max(n)", "sess_events_std": "stddev_samp(double(n))",
            "sess_dur_mean": "avg(dur)", "sess_dur_max": "max(dur)", "sess_rate_mean": "avg(n / (dur + 1D))", "sess_longest_share": "max(n) / sum(n)", "sess_gap_mean": "avg(gap)",
        },
    )


def content(ev: DataFrame, s: Settings) -> DataFrame:
    columns = ("item_category", "item_location", "item_id", "search_query")
    base = summarise(ev, {"n": "count(*)", "known": "count(seller_type)", "pro": "count_if(seller_type = 'pro')"})
    values = value_counts(ev, {c: c for c in columns})
    base = merge(base, values).na.fill(0, [f"{c}_{x}" for c in columns for x in "un"])
    out: dict[str, object] = {}
    for c in columns:
        out |= {f"{c}_nuniq": f"{c}_u", f"{c}_uniq_ratio": div(f"{c}_u", f"{c}_n + 1"), f"{c}_per_event": div(f"{c}_u", "n"), f"{c}_entropy": f"{c}_h"}
    out |= {
        "seller_pro_rate": div("pro", "known"), "seller_known_rate": div("known", "n"), "item_repeat_rate": F.expr("1 - item_id_u / (item_id_n + 1D)"),
        "items_per_category": div("item_id_u", "item_category_u + 1"), "locations_per_category": div("item_location_u", "item_category_u + 1"),
    }
    return derive(base, out)


def pagination(ev: DataFrame, s: Settings) -> DataFrame:
    paged = ev.where("search_page IS NOT NULL")
    paged = paged.withColumn("step", F.col("search_page") - F.lag("search_page").over(by_time()))
    out = summarise(
        paged,
        {
            "page_mean": "avg(search_page)", "page_max": "max(search_page)", "page_std": "stddev_samp(double(search_page))", "page_first_share": "avg(double(search_page = 1))",
            "page_deep_share": f"avg(double(search_page > {s.deep_page}))", "page_step_up_share": "avg(double(coalesce(step = 1, false)))",
            "page_step_up_count": "count_if(step = 1)", "queries_nuniq": "count(DISTINCT search_query)", "pages_per_query": "count(*) / (count(DISTINCT search_query) + 1D)",
            "query_repeat_rate": "1 - count(DISTINCT search_query) / double(count(*))", "query_len_mean": "avg(char_length(search_query))",
        },
    )
    longest = summarise(runs(paged, "step = 1"), {"page_run_max": "max(n)"})
    told = merge(out, longest).na.fill(0, ["page_run_max"])
    # only the count of steps is known, as 0, for visitors without a search
    return ev.select(KEY).distinct().join(told, KEY, "left").na.fill(0, ["page_step_up_count"])


_MOVE = "hypot(dx, dy)"


def _moves(ev: DataFrame) -> DataFrame:
    w = by_time()
    seen = ev.where("pointer_x IS NOT NULL AND pointer_y IS NOT NULL")
    seen = seen.withColumn("dx", F.col("pointer_x") - F.lag("pointer_x").over(w)).withColumn("dy", F.col("pointer_y") - F.lag("pointer_y").over(w))
    seen = seen.withColumn("pdt", F.col("sec") - F.lag("sec").over(w)).withColumn("step", F.expr(_MOVE)).withColumn("speed", F.expr("step / (pdt + 1D)"))
    seen = seen.withColumn("angle", F.expr("CASE WHEN dx IS NOT NULL THEN atan2(dy, dx) END")).withColumn("bend", F.abs(F.col("angle") - F.lag("angle").over(w)))
    return seen.withColumn("turn", F.expr("least(bend, 2 * pi() - bend)"))


def pointer(ev: DataFrame, s: Settings, prefix: str = "") -> DataFrame:
    coverage = summarise(ev, {"pointer_coverage": "count(pointer_x) / double(count(*))"})
    out = summarise(
        _moves(ev),
        {
            "ptr_x_std": "stddev_samp(pointer_x)", "ptr_y_std": "stddev_samp(pointer_y)", "ptr_x_mean": "avg(pointer_x)", "ptr_y_mean": "avg(pointer_y)",
            "ptr_bbox": "(max(pointer_x) - min(pointer_x)) * (max(pointer_y) - min(pointer_y))", "ptr_uniq_share": "size(collect_set(struct(pointer_x, pointer_y))) / double(count(*))",
            "ptr_step_med": "percentile(step, 0.5)", "ptr_step_std": "stddev_samp(step)", "ptr_speed_med": "percentile(speed, 0.5)", "ptr_speed_max": "max(speed)",
            "ptr_step_cv": "stddev_samp(step) / (avg(step) + 1)",
        },
    )
    out = merge(coverage, out)
    return out.select(KEY, *(ref(c).alias(prefix + c) for c in out.columns if c != KEY))


def pointer_deep(ev: DataFrame, s: Settings) -> DataFrame:
    width, height = s.screen
    seen = _moves(ev).withColumn("quadrant", F.expr(f"2 * int(pointer_x > {width} / 2) + int(pointer_y > {height} / 2)"))
    seen = seen.withColumn("centre", F.expr(f"hypot(pointer_x - {width} / 2, pointer_y - {height} / 2)")).withColumn("step_bucket", F.expr("floor(log1p(step))"))
    stamp = "struct(event_ts, event_id)"
    facts = {
        "ptrd_step_q10": "percentile(step, 0.1)", "ptrd_step_q50": "percentile(step, 0.5)", "ptrd_step_q90": "percentile(step, 0.9)", "ptrd_zero_step_share": "avg(double(step = 0))",
        "ptrd_path_len": "sum(step)", "ends": f"hypot(max_by(pointer_x, {stamp}) - min_by(pointer_x, {stamp}), max_by(pointer_y, {stamp}) - min_by(pointer_y, {stamp}))",
        "ptrd_turn_med": "percentile(turn, 0.5)", "ptrd_turn_std": "stddev_samp(turn)", "ptrd_reversal_share": "avg(double(turn > pi() / 2))",
        "ptrd_x_mod10": "avg(double(pointer_x % 10 = 0))", "ptrd_y_mod10": "avg(double(pointer_y % 10 = 0))",
        "ptrd_edge_share": f"avg(double(pointer_x <= 1 OR pointer_y <= 1 OR pointer_x >= {width - 1} OR pointer_y >= {height - 1}))",
        "ptrd_centre_dist_med": "percentile(centre, 0.5)", "ptrd_centre_dist_std": "stddev_samp(centre)", 
        "ptrd_bbox_fill": f"(max(pointer_x) - min(pointer_x)) * (max(pointer_y) - min(pointer_y)) / {float(width * height)}D", 
        "ptrd_speed_q10": "percentile(speed, 0.1)", "ptrd_speed_q90": "percentile(speed, 0.9)", "ptrd_speed_std": "stddev_samp(speed)",
    }
    out = seen.groupBy(KEY).agg(*(F.expr(e).alias(n) for n, e in facts.items()), corr("pointer_x", "pointer_y").alias("ptrd_xy_corr"))
    out = out.withColumns({"ptrd_straightness": F.expr("ends / (ptrd_path_len + 1)"), }).drop("ends")
    cover = summarise(ev, {f"ptrd_cover_{x}": f"avg(CASE WHEN event_name = '{x}' THEN double(pointer_x IS NOT NULL) END)" for x in ("item_view", "search_results_view", "photo_swipe")})
    values = value_counts(seen, {"step": "step_bucket", "quadrant": "quadrant", "place": "concat_ws(':', pointer_x, pointer_y)"})
    values = derive(values, {"ptrd_step_entropy": "step_h", "ptrd_quadrant_entropy": "quadrant_h", "ptrd_quadrants": "quadrant_u", "ptrd_repeat_share": "1 - place_u / double(place_n)"})
    return merge(out, values, cover)


def user_agent_facts(ev: DataFrame, s: Settings) -> DataFrame:
    """Family, versions and device of each event's user agent; a pattern without match gives NULL."""
    pick = lambda pattern: F.nullif(F.regexp_extract("user_agent", pattern, 1), F.lit(""))
    whole = lambda c: c.try_cast("bigint")
    return ev.withColumns(
        {
            "family": F.coalesce(pick(f"^({'|'.join((s.app_name, *C.SCRIPT_CLIENTS))})/"), pick(f"({'|'.join(C.BROWSERS)})"), F.lit("other")),
            "app_version": whole(pick(f"^{s.app_name}/([0-9]+)")),
            "os_version": whole(F.coalesce(pick("Android ([0-9]+)"), pick("iOS ([0-9]+)"))),
            "browser_version": whole(pick("(?:Chrome|Firefox|Safari)/([0-9]+)")),
            "device": pick("(?:Android [0-9]+; |iPhone; iOS [0-9.]+; )([^)]+)"),
        }
    )


def client(ev: DataFrame, s: Settings) -> DataFrame:
    """User-agent and device frequencies are those of the whole log, fit and scored visitors alike.

    A frequency is counted once per distinct agent; that table is small and joined back, so a common agent's rows
    never meet in one task. Agents are read by their patterns once for each visitor, not for each event, and
    written, as both frequencies and the visitors read them.
    """
    own = written(user_agent_facts(ev.groupBy(KEY, "user_agent").agg(F.count("*").alias("c")), s), "client")
    agents = own.groupBy("user_agent").agg(F.sum("c").alias("ua_freq"))
    devices = own.where("device IS NOT NULL").groupBy("device").agg(F.sum("c").alias("n"))
    devices = devices.select("device", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("device_freq"))
    families = (s.app_name, *C.SCRIPT_CLIENTS, *C.BROWSERS, "other")
    own = own.join(agents, "user_agent", "left").join(devices, "device", "left")
    part = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0)) / F.sum("c")
    agent = F.col("user_agent")
    facts = {"n_user_agents": F.size(F.collect_set("user_agent")), "ua_headless_rate": part(agent.contains("Headless")), "ua_mobile_rate": part(agent.rlike("(?i)Android|iPhone|Mobile"))}
    facts |= {f"uafam_{f}": part(F.col("family") == F.lit(f)) for f in families}
    facts |= {"ua_script_rate": part(F.col("family").isin(*C.SCRIPT_CLIENTS)), "ua_app_version": F.max("app_version"), "ua_os_version": F.max("os_version"), "ua_browser_version": F.max("browser_version")}
    facts |= {"ua_device_freq": F.expr("sum(device_freq * c) / sum(IF(device_freq IS NOT NULL, c, NULL))"), "ua_freq_min": F.min("ua_freq"), "ua_freq_mean": F.expr("sum(ua_freq * c) / sum(c)")}
    shares = ev.groupBy(KEY).agg(*(share(F.col("platform") == F.lit(p)).alias(f"plat_{p}") for p in C.PLATFORMS))
    platforms = derive(value_counts(ev, {"platform": "platform"}), {"n_platforms": "platform_u", "platform_entropy": "platform_h"})
    return merge(shares, platforms, own.groupBy(KEY).agg(*(c.alias(n) for n, c in facts.items())))


def id_structure(ev: DataFrame, s: Settings) -> DataFrame:
    items = ev.where("item_id IS NOT NULL")
    items = items.withColumn("step", F.col("item_id") - F.lag("item_id").over(by_time()))
    return summarise(
        items,
        {
            "idst_std": "stddev_samp(double(item_id))", "idst_range": "max(item_id) - min(item_id)", "idst_iqr": "percentile(item_id, 0.75) - percentile(item_id, 0.25)", "idst_median": "percentile(item_id, 0.5)",
            "idst_up_share": "avg(double(step > 0))", "idst_step_abs_med": "percentile(abs(step), 0.5)", "idst_prefix_nuniq": "count(DISTINCT floor(item_id / 1000))",
            "idst_range_per_item": "(max(item_id) - min(item_id)) / (count(DISTINCT item_id) + 1D)",
        },
    )


def dt_granularity(ev: DataFrame, s: Settings) -> DataFrame:
    counts = ev.where("dt IS NOT NULL").groupBy(KEY, "dt").agg(F.count("*").alias("c"))
    facts = {"dtg_nuniq": "count(*)", "dtg_uniq_frac": "count(*) / double(sum(c))", "dtg_mode_count": "max(c)"}
    facts |= {f"dtg_round{k}": f"sum(IF(dt % {k} = 0, c, 0)) / double(sum(c))" for k in s.round_gaps}
    return summarise(counts, facts)


def top_values(ev: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of fit visitors' events, by count and then by value. ``ev`` has ``is_fit``."""
    return ev.where(f"is_fit AND {column} IS NOT NULL").groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def catalog_vocabulary(ev: DataFrame, s: Settings) -> dict[str, list[str]]:
    """Top values of fit visitors by column; at most the stated number each comes to the driver."""
    return {column: [r[column] for r in top_values(ev, column, k).collect()] for column, k in s.catalog_tops}


def catalog_shares(ev: DataFrame, s: Settings, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Share of each top value; NULL for a visitor without any value of the vocabulary."""
    facts, names = [], dict(s.catalog_names)
    for column, values in vocabulary.items():
        known = F.count_if(F.col(column).isin(*values)) if values else F.lit(0)
        facts += [F.when(known > 0, F.count_if(F.col(column) == F.lit(v)) / F.count(column)).alias(f"{names[column]}_{v}") for v in values]
    return ev.groupBy(KEY).agg(*facts) if facts else ev.select(KEY).distinct()


def popularity(ev: DataFrame, s: Settings, pool: str = "'all'") -> DataFrame:
    """How popular a visitor's items are with others, as average percentiles over (pool, visitor, item) pairs.

    Percentiles come from the distinct values of a pool and their counts, not from a window over all pairs: a pool
    holds every pair, its distinct values are few.
    """
    pairs = ev.where("item_id IS NOT NULL").groupBy(F.expr(pool).alias("pool"), KEY, "item_id").agg(F.count("*").alias("own"))
    totals = pairs.groupBy("pool", "item_id").agg(F.count("*").alias("audience"), F.sum("own").alias("views"))
    pairs = pairs.join(totals, ["pool", "item_id"]).withColumns({"others": F.expr("audience - 1"), "other_views": F.expr("views - own")})

    def ranks(value: str, name: str) -> DataFrame:
        counts = pairs.groupBy("pool", value).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("pool").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return counts.select("pool", value, ((upto - F.col("c") + (F.col("c") + 1) / 2) / F.sum("c").over(Window.partitionBy("pool"))).alias(name))

    placed = pairs.join(ranks("others", "pct"), ["pool", "others"]).join(ranks("other_views", "views_pct"), ["pool", "other_views"])
    return summarise(
        placed,
        {
            "pop_pct_mean": "avg(pct)", "pop_pct_med": "percentile(pct, 0.5)", "pop_pct_max": "max(pct)", "pop_pct_std": "stddev_samp(pct)",
            "pop_views_pct_mean": "avg(views_pct)", "pop_views_pct_std": "stddev_samp(views_pct)", "pop_solo_share": "avg(double(others <= 0))",
        },
    )


def crowd(ev: DataFrame, s: Settings) -> DataFrame:
    """Dwell and page against the medians of fit visitors, by event type and by query."""
    dwell = ev.where("dwell IS NOT NULL").withColumn("log_dwell", F.log1p(F.greatest("dwell", F.lit(0))))
    usual = dwell.where("is_fit").groupBy("event_name").agg(F.expr("percentile(log_dwell, 0.5)").alias("usual"))
    dwell = dwell.join(F.broadcast(usual), "event_name", "left").withColumn("off", F.expr("log_dwell - usual"))  # a row per event type
    paged = ev.where("search_page IS NOT NULL AND search_query IS NOT NULL")
    depth = paged.where("is_fit").groupBy("search_query").agg(F.expr("percentile(search_page, 0.5)").alias("usual"))
    paged = paged.join(depth, "search_query", "left").withColumn("off", F.expr("search_page - usual"))
    one = summarise(dwell, {"crowd_dwell_mean": "avg(off)", "crowd_dwell_std": "stddev_samp(off)", "crowd_dwell_med": "percentile(off, 0.5)"})
    return one.join(summarise(paged, {"crowd_page_mean": "avg(off)", "crowd_page_max": "max(off)"}), KEY, "full")


def conditional_timing(ev: DataFrame, s: Settings) -> DataFrame:
    facts = {}
    for x in C.DWELL_EVENTS:
        of = f"CASE WHEN event_name = '{x}' THEN double(dwell) END"
        facts |= {f"dwell_{x}_med": f"percentile({of}, 0.5)", f"dwell_{x}_mean": f"avg({of})", f"dwell_{x}_std": f"stddev_samp({of})"}
    out = summarise(ev.where("dwell IS NOT NULL"), facts)
    return out.withColumn("dwell_item_vs_search", F.expr("dwell_item_view_med / (dwell_search_results_view_med + 1)"))


def navigation(ev: DataFrame, s: Settings) -> DataFrame:
    n = {x: f"count_if(event_name = '{x}')" for x in C.EVENT_NAMES}
    contact = f"count_if(event_name IN ({_names(C.CONTACT)}))"
    facts = {
        "funnel_items_per_search": f"{n['item_view']} / ({n['search_results_view']} + 1D)", "funnel_contact_per_item": f"{contact} / ({n['item_view']} + 1D)",
        "funnel_seller_per_item": f"{n['seller_page_view']} / ({n['item_view']} + 1D)", "funnel_swipe_per_item": f"{n['photo_swipe']} / ({n['item_view']} + 1D)",
    }
    # one sort by visitor and time tells each event's place in the runs of all columns, so that runs are neither grouped nor joined
    w, kinds = by_time(), {"cat": "item_category", "loc": "item_location", "query": "search_query"}
    upto, behind = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = ev.select(KEY, *ORDER, "event_name", "item_id", *kinds.values()).withColumn("at", F.row_number().over(w))
    rows = rows.withColumns({f"before_{k}": F.last(c, ignorenulls=True).over(behind) for k, c in kinds.items()})
    rows = rows.withColumns({f"changed_{k}": F.expr(f"int({c} <> before_{k})") for k, c in kinds.items()})
    rows = rows.withColumns({f"known_{k}": F.count(f"changed_{k}").over(upto) for k in kinds} | {"other_upto": F.max(F.expr("CASE WHEN event_name = 'photo_swipe' THEN NULL ELSE at END")).over(upto)})
    rows = rows.withColumns({f"since_{k}": F.max(F.expr(f"CASE WHEN changed_{k} = 1 THEN known_{k} END")).over(upto) for k in kinds})
    for k in kinds:  # a row that is not the first begins a run where its value changed; the first begins one in any case
        facts |= {f"nav_{k}_switch_rate": f"avg(changed_{k})", f"nav_{k}_run_mean": f"try_divide(double(count(changed_{k})), double(count_if(changed_{k} = 1 OR (changed_{k} = 0 AND known_{k} = 1))))"}
        facts |= {f"nav_{k}_run_max": f"max(CASE WHEN changed_{k} IS NOT NULL THEN known_{k} - coalesce(since_{k}, 1) + 1 END)"}
    seen = F.row_number().over(Window.partitionBy(KEY, "item_id").orderBy(F.lit(0)))
    rows = rows.withColumn("seen", F.when(F.col("item_id").isNotNull(), seen))
    return summarise(rows, facts | {"swipe_run_max": "max(CASE WHEN event_name = 'photo_swipe' THEN at - coalesce(other_upto, 0) ELSE 0 END)", "item_revisit_max": "max(seen)"})


def scoped(rows: DataFrame, s: Settings, prefix: str, families: tuple) -> DataFrame:
    """Families over a part of the events; ``rows`` were cut before they were enriched, so gaps skip the rest."""
    out = merge(*(f(rows, s) for f in families)) if len(families) > 1 else families[0](rows, s)
    return out.select(KEY, *(ref(c).alias(prefix + c) for c in out.columns if c != KEY))


def binned(ev: DataFrame, s: Settings, width: int, prefix: str) -> DataFrame:
    """Counts in bins of ``width`` seconds from the visitor's first event."""
    first = F.min("sec").over(Window.partitionBy(KEY))
    bins = ev.withColumn("bin", F.floor((F.col("sec") - first) / width)).groupBy(KEY, "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy(KEY).orderBy("bin")
    bins = bins.withColumn("off", F.greatest(F.col("bin") - F.lag("bin").over(w) - 1, F.lit(0))).withColumn("island", F.col("bin") - F.row_number().over(w))
    on = bins.groupBy(KEY, "island").agg(F.count("*").alias("n"))
    out = summarise(
        bins,
        {
            f"{prefix}_max": "max(c)", f"{prefix}_mean": "avg(c)", f"{prefix}_fano": "var_samp(double(c)) / avg(c)", f"{prefix}_occupancy": "count(*) / (max(bin) + 1D)",
            f"{prefix}_entropy": "ln(sum(c)) - sum(c * ln(c)) / sum(c)", f"{prefix}_peak_share": "max(c) / double(sum(c))", f"{prefix}_run_off": "coalesce(max(off), 0)",
        },
    )
    return merge(out, summarise(on, {f"{prefix}_run_on": "max(n)"}))


def irregular(ev: DataFrame, s: Settings) -> DataFrame:
    day = "2 * pi() * (sec % 86400) / 86400D"
    base = summarise(ev, {"n": "count(*)", "c": f"avg(cos({day}))", "d": f"avg(sin({day}))"})
    base = derive(base, {"tod_resultant": "hypot(c, d)", "tod_rayleigh": "n * (c * c + d * d)"})
    gaps = ev.where("dt IS NOT NULL")
    modal = gaps.groupBy(KEY).agg(F.mode("dt", True).alias("modal"))
    logs = summarise(gaps, {"gap_log_std": "stddev_samp(log1p(dt))", "gap_log_iqr": "percentile(log1p(dt), 0.75) - percentile(log1p(dt), 0.25)"})
    near = summarise(gaps.join(modal, KEY), {"gap_near_mode": "avg(double(abs(dt - modal) <= 1))"})
    triples = ev.where("dt_third IS NOT NULL").withColumn("shape", F.expr("concat(int(dt_third <= dt_before), int(dt_third <= dt), int(dt_before <= dt))"))
    order = triples.groupBy(KEY, "shape").agg(F.count("*").alias("c")).groupBy(KEY)
    order = order.agg(F.expr("CASE WHEN sum(c) >= 2 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(6) END").alias("gap_perm_entropy"))
    return merge(base, logs, near, order)


def window_coverage(ev: DataFrame, cookies: DataFrame, s: Settings) -> DataFrame:
    bounds = cookies.select(KEY, *(seconds(cookies, c).alias(n) for c, n in (("window_start_ts", "start"), ("window_end_ts", "stop"))))
    ends = summarise(ev, {"a": "min(sec)", "b": "max(sec)"}).join(bounds, KEY)
    return derive(ends, {"first_event_offset_h": "(a - start) / 3600D", "last_event_offset_h": "(stop - b) / 3600D", "window_coverage": f"(b - a) / 3600D / {s.coverage_hours}D"})


def cookie_meta(cookies: DataFrame) -> DataFrame:
    at = {c: seconds(cookies, c) for c in ("window_start_ts", "cookie_created_at")}
    age = (at["window_start_ts"] - at["cookie_created_at"]) / 86400.0
    return cookies.select(
        KEY,
        age.alias("cookie_age_days"),
        F.log1p(F.greatest(age, F.lit(0.0))).alias("cookie_age_log"),
        F.hour("cookie_created_at").alias("cookie_created_hour"),
        F.weekday("cookie_created_at").alias("cookie_created_dow"),
        F.weekday("window_start_ts").alias("window_dow"),
    )


# The columns that are compared within a platform.
RELATIVE_BASE = (
    "n_events",
    "dt_q50",
    "dt_iqr",
    "dtg_uniq_frac",
    "sess_events_mean",
    "item_location_nuniq",
    "item_category_nuniq",
    "item_id_nuniq",
    "page_mean",
    "page_max",
    "rate_item_view",
    "rate_engagement",
    "funnel_items_per_search",
    "webp_pointer_coverage",
    "nav_loc_switch_rate",
    "dwell_item_view_med",
    "ptrd_straightness",
    "events_per_h",
    "idst_range",
    "ua_freq_mean",
)


def relative(features: DataFrame, columns: tuple[str, ...] = RELATIVE_BASE) -> DataFrame:
    """Share of fit visitors of the same dominant platform at or below a visitor's value.

    ``features`` has plat_* shares and is_fit. Values that agree to nine digits are one value. The values of all columns
    are counted by (platform, value) first, so the running sum goes over distinct values and not over visitors.
    """
    top = F.greatest(*(F.col(f"plat_{p}") for p in C.PLATFORMS))
    platform = F.coalesce(*(F.when(F.col(f"plat_{p}") == top, p) for p in C.PLATFORMS))
    rows = features.withColumn("platform", platform)
    long = rows.select(KEY, "platform", "is_fit", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), rounded(F.col(c).cast("double"), 9).alias("v")) for c in columns))).alias("x")).select(KEY, "platform", "is_fit", "x.*")
    known = long.where("v IS NOT NULL AND platform IS NOT NULL").groupBy("name", "platform", "v").agg(F.count_if("is_fit").alias("fit"))
    known = running(known, "v", {"upto": "fit"}, ("name", "platform"))
    known = known.join(known.groupBy("name", "platform").agg(F.sum("fit").alias("all_fit")), ["name", "platform"])  # a row for each column and platform
    share = F.try_divide(F.col("upto").cast("double"), F.col("all_fit").cast("double"))
    placed = long.join(known.select("name", "platform", "v", share.alias("share")), ["name", "platform", "v"], "left")
    wide = placed.groupBy(KEY).pivot("name", list(columns)).agg(F.max("share"))
    codes = F.create_map(*(F.lit(x) for k, p in enumerate(sorted(C.PLATFORMS)) for x in (p, k)))
    out = wide.select(KEY, *(F.col(c).alias(f"rel_plat_{c}") for c in columns))
    return rows.select(KEY, codes[F.col("platform")].alias("dominant_platform")).join(out, KEY)
