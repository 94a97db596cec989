"""Hand-checked frames for the rules that are easy to get wrong."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.config import FIXTURE, Settings
from clickloom.functions import kernels as K
from clickloom.operators import analysis, encoding, events, families, metrics, models, sequences
from clickloom.sources import readers
from clickloom.streaming.sessions import session_counts

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, cookie_id long, event_ts timestamp_ntz, event_name string, platform string, item_id long, item_category string, item_location string, search_query string, search_page int, seller_type string, pointer_x double, pointer_y double, user_agent string, is_fit boolean"


def log(spark, *rows):
    """Rows of (seconds, event name, more columns by name), all of visitor 1."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    full = []
    for i, (at, name, *more) in enumerate(rows):
        r = dict.fromkeys(names) | {"event_id": i, "cookie_id": 1, "event_ts": T0 + timedelta(seconds=at), "event_name": name, "platform": "web", "user_agent": "x", "is_fit": True}
        full.append(tuple((r | (more[0] if more else {}))[n] for n in names))
    return spark.createDataFrame(full, SCHEMA)


def scored(spark, ys, ss):
    return spark.createDataFrame(list(zip(ys, map(float, ss))), "y long, s double")


@pytest.mark.parametrize(("ys", "ss", "want"), [([1, 0, 1, 1, 1], [5, 4, 3, 2, 1], 0.8), ([1, 1, 0, 0], [0.5] * 4, 0.5), ([0, 0, 1, 1], [0.5] * 4, 0.5), ([0, 0], [1, 2], None)])
def test_precision_at_recall(spark, ys, ss, want):
    assert metrics.precision_at_recall(scored(spark, ys, ss)).first()[0] == want


def test_recall_at_fpr_of_one_tie_is_zero(spark):
    assert metrics.recall_at_fpr(scored(spark, [1] * 10 + [0] * 90, [0.5] * 100)).first()[0] == 0.0


def test_metrics_match_pair_counting(spark):
    ys, ss = [1, 0, 1, 0, 0, 1], [3, 3, 2, 2, 1, 0]
    pairs = [(a > b) + (a == b) / 2 for a, y in zip(ss, ys) if y for b, z in zip(ss, ys) if not z]
    row = metrics.score(scored(spark, ys, ss)).first()
    assert row["roc_auc"] == pytest.approx(sum(pairs) / 9)
    assert row["average_precision"] == pytest.approx((1 / 2 + 2 / 4 + 3 / 6) / 3)


def test_percent_rank_shares_ties(spark):
    df = K.percent_ranks(spark.createDataFrame([(x,) for x in (2, 2, 5, 5, 9)], "x int"), "x", "p")
    assert sorted(r["p"] for r in df.collect()) == [0.3, 0.3, 0.7, 0.7, 1.0]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("pieces", [1, 3, 1000])
def test_running_sums_match_adding(spark, descending, pieces):
    values = [None, -5.0, -4.999, 0.0, 0.1, 0.2, 7.0, 1e9]
    rows = [(g, v, i + 1) for g in "ab" for i, v in enumerate(values) if g == "a" or i < 2]
    got = K.running(spark.createDataFrame(rows, "g string, v double, n long"), "v", {"upto": "n"}, ("g",), descending, pieces).collect()
    order = lambda v: (v is not None, v or 0)  # noqa: E731  NULL first, and last if descending
    for r in got:
        want = sum(n for g, v, n in rows if g == r["g"] and (order(v) >= order(r["v"]) if descending else order(v) <= order(r["v"])))
        assert r["upto"] == want
    assert len(got) == len(rows)


def test_session_at_exactly_the_gap(spark):
    s = Settings()
    ev = events.enrich(log(spark, (0, "login"), (1800, "login"), (3601, "login")), s)
    assert families.sessions(ev, s).first()["n_sessions"] == 2


def test_single_event_has_null_spread(spark):
    ev = events.enrich(log(spark, (0, "login")), Settings())
    row = families.timing(ev, Settings()).first()
    assert row["span_h"] == 0 and row["dt_mean"] is None and row["dt_autocorr1"] is None


def test_window_edges_and_leak_check(spark):
    rows = log(spark, (0, "login"), (86400, "login"), (-1, "login"))
    meta = spark.createDataFrame([(1, T0, T0, T0 + timedelta(days=1))], "cookie_id long, cookie_created_at timestamp_ntz, window_start_ts timestamp_ntz, window_end_ts timestamp_ntz")
    kept = events.clip_to_window(rows, meta)
    assert [r["event_id"] for r in kept.collect()] == [0]
    events.assert_no_leak(kept, meta)
    with pytest.raises(ValueError):
        events.assert_no_leak(rows, meta)


def test_first_page_row_counts_in_the_denominator(spark):
    page = lambda p: {"search_page": p, "search_query": "q"}
    ev = events.enrich(log(spark, *((i, "search_results_view", page(p)) for i, p in enumerate((1, 2, 3, 7)))), Settings())
    row = families.pagination(ev, Settings()).first()
    assert row["page_step_up_share"] == 0.5 and row["page_run_max"] == 2


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, float(i)) for i in range(5)], "cookie_id long, a double, b double")
    assert df.groupBy("cookie_id").agg(K.corr("a", "b").alias("r")).first()["r"] is None


def test_shares_sum_to_one_and_row_order_is_free(spark):
    rows = log(spark, *((i * 7 % 50, n) for i, n in enumerate(["login", "item_view", "photo_swipe", "item_view"] * 3)))
    one = families.volume_and_mix(events.enrich(rows, FIXTURE), FIXTURE).first().asDict()
    two = families.volume_and_mix(events.enrich(rows.orderBy(F.desc("event_id")), FIXTURE), FIXTURE).first().asDict()
    assert one == two
    assert sum(v for k, v in one.items() if k.startswith("rate_") and k not in ("rate_engagement", "rate_contact")) == pytest.approx(1)


def test_duplicate_columns_need_equal_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (2, None, None, None)], "cookie_id long, a double, b double, c double")
    assert [tuple(r) for r in encoding.duplicate_columns(df, "cookie_id", ["a", "b", "c"]).collect()] == [("b", "a")]


def test_gzip_ratio_of_nothing_is_null(spark):
    df = spark.createDataFrame([("ab" * 200,), ("",), (None,)], "t string").select(sequences.gzip_ratio("t").alias("r"))
    got = [r["r"] for r in df.collect()]
    assert got[0] < 0.2 and got[1:] == [None, None]


def test_scores_are_refused_or_written(spark, tmp_path):
    wanted = spark.createDataFrame([(i,) for i in range(10)], "cookie_id long")
    good = wanted.withColumn("score", F.col("cookie_id") / 10.0)
    readers.write_scores(good, wanted, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 10
    with pytest.raises(ValueError):
        readers.write_scores(good.withColumn("score", F.lit(2.0)), wanted, f"{tmp_path}/no")


def test_models_separate_an_easy_class(spark):
    rows = [(i, i % 2, float(i % 2) + (i % 7) / 100 if i % 5 else None, i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "cookie_id long, target int, x double, day_index int")
    scores = models.predict(models.fit(df, ["x"], "linear"), df, ["x"]).join(df, "cookie_id")
    assert metrics.roc_auc(scores.select(F.col("target").alias("y"), F.col("score").alias("s"))).first()[0] > 0.8


def test_streamed_sessions_close_after_the_gap(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0 + timedelta(minutes=m)) for m in (0, 10, 100, 400)], "cookie_id long, event_ts timestamp_ntz")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = session_counts(stream, late="0 seconds").writeStream.format("memory").queryName("closed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("closed").collect()) == [1, 2]


def _labelled(spark, n=60):
    rows = [(i, i % 2, float(i % 2 * 10 + i % 7), float(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "cookie_id long, target int, good double, noise double")


def test_calibration_is_monotone(spark):
    rows = spark.createDataFrame([(0, 0.1), (1, 0.2), (0, 0.3), (1, 0.4), (1, 0.9)], "y long, s double")
    got = [r["p"] for r in analysis.calibrated(rows, rows).orderBy("s").collect()]
    assert got == pytest.approx([0, 0.5, 0.5, 1, 1])


def test_ablation_names_the_block_that_matters(spark):
    told = analysis.ablation(_labelled(spark), ["good", "noise"], {"a": "^good", "b": "^no"}, "linear", 2)
    assert [x["without"] for x in told] == [None, "a", "b"] and told[0]["uncovered"] == []
    assert told[0]["average_precision"] == told[2]["average_precision"] == 1.0 > told[1]["average_precision"]


def test_search_restores_the_learners(spark):
    before = set(models.LEARNERS)
    found = analysis.search(_labelled(spark), ["good"], {"regParam": [0.01, 0.1]}, "linear", 2)
    assert [x[0]["regParam"] for x in found] == [0.01, 0.1] and found[0][1] == 1.0 and set(models.LEARNERS) == before


def test_stacked_scores_every_row_once(spark):
    df = _labelled(spark)
    got = analysis.stacked(df, df.drop("target"), ["good", "noise"], ("linear",), k=2)
    assert got.count() == 60 and got.where("score IS NULL").count() == 0


def test_prevalence_without_a_class_keeps_all_rows(spark):
    one = spark.createDataFrame([(1, 0), (2, 0)], "id long, y int")
    assert analysis.at_prevalence(one, 0.2).count() == 2


def test_matrix_keeps_visitors_without_events_and_equals_its_families(spark):
    from clickloom.plans.features import build_features, prepare
    from clickloom.sources import fixture

    sf = "/root/testdata/sf0.001"
    clicks, cookies = fixture.clicks(spark, sf), fixture.cookies(spark, sf)
    some = clicks.where("cookie_id <> 3")
    matrix = build_features(some, cookies, FIXTURE)
    rows = {r["cookie_id"]: r for r in matrix.collect()}
    assert len(rows) == cookies.count() and rows[3]["n_events"] is None and rows[3]["cookie_age_days"] is not None
    ev = events.enrich(prepare(some, cookies), FIXTURE)
    mobile = events.enrich(prepare(some, cookies).where("platform IN ('android', 'ios')"), FIXTURE)
    for r in families.sessions(ev, FIXTURE).collect():
        assert rows[r["cookie_id"]]["n_sessions"] == r["n_sessions"]
    for r in families.timing(mobile, FIXTURE).collect():
        assert rows[r["cookie_id"]]["mob_dt_mean"] == r["dt_mean"]


def test_matrix_has_the_columns_of_every_step(spark, monkeypatch):
    from clickloom.plans import features as plans
    from clickloom.sources import fixture

    sf, whole, seen = "/root/testdata/sf0.001", plans.all_features, []
    monkeypatch.setattr(plans, "all_features", lambda *a: seen.append(whole(*a)) or seen[0])
    clicks, cookies = fixture.clicks(spark, sf), fixture.cookies(spark, sf)
    got = plans.build_features(clicks, cookies, FIXTURE)
    full = seen[0]
    ev = events.enrich(plans.prepare(clicks, cookies), FIXTURE)
    of = lambda f, prefix="": {prefix + c for c in f.columns if c != "cookie_id"}
    wanted = set().union(
        *(of(f(ev, FIXTURE)) for f in (families.volume_and_mix, families.timing, families.sessions, families.content, families.pagination, families.pointer, families.client)),
        *(of(f(ev, FIXTURE)) for f in (families.id_structure, families.dt_granularity, families.popularity, families.crowd, families.conditional_timing, families.navigation)),
        *(of(f(ev, FIXTURE)) for f in (families.pointer_deep, sequences.compression, families.irregular)),
        *(of(families.binned(ev, FIXTURE, w, n)) for w, n in zip(FIXTURE.bin_widths, FIXTURE.bin_names)),
        of(families.pointer(ev, FIXTURE), "webp_"), of(families.timing(ev, FIXTURE), "web_"), of(families.timing(ev, FIXTURE), "mob_"), of(families.navigation(ev, FIXTURE), "mob_"),
        of(families.transitions(ev, FIXTURE, [])), of(families.window_coverage(ev, cookies, FIXTURE)), of(families.cookie_meta(cookies)),
        {f"{p}_{k}" for p in ("seqo", "seqp") for k in range(8)}, {f"rel_plat_{c}" for c in families.RELATIVE_BASE}, {"dominant_platform"},
    )
    assert wanted <= set(full.columns) and any(c.startswith("bg_") for c in full.columns) and any(c.startswith("shq_o'q.") for c in full.columns)
    rows = {r["cookie_id"]: r.asDict() for r in full.collect()}
    kept = {r["cookie_id"]: r.asDict() for r in got.collect()}
    assert kept.keys() == rows.keys() and any(r["seqo_0"] for r in kept.values())
    values = lambda c: tuple(rows[k][c] for k in sorted(rows))
    assert "webp_ptr_x_std" not in got.columns and "ptr_x_std" in got.columns
    left = [values(c) for c in got.columns]
    assert len(set(left)) == len(left) and {values(c) for c in full.columns} == set(left)


def test_matrix_scrubs_what_is_no_number(spark):
    from clickloom.plans.features import cleaned

    df = spark.createDataFrame([(1, float("nan"), 1, 1.0), (2, float("inf"), 2, 2.0), (3, 0.5, 3, 3.0)], "cookie_id long, a double, b long, c double")
    assert sorted(map(tuple, cleaned(df).collect())) == [(1, None, 1), (2, None, 2), (3, 0.5, 3)]


def test_sequences_without_a_common_term_have_null_components(spark):
    ev = events.enrich(log(spark, (0, "login"), (5, "login")), Settings())
    got = sequences.sequence_svd(sequences.token_documents(ev, Settings()), ev.select("cookie_id").distinct(), "ordered", "seqo", 3)
    assert [tuple(r) for r in got.collect()] == [(1, *[None] * 8)]


def test_all_relative_columns_match_counting(spark):
    from clickloom.config import PLATFORMS
    from clickloom.plans.features import relative_base
    from clickloom.plans.queries import queries
    from clickloom.sources import fixture

    sf = "/root/testdata/sf0.001"
    base = [r.asDict() for r in relative_base(fixture.clicks(spark, sf), fixture.cookies(spark, sf), FIXTURE).collect()]
    top = lambda r: max(PLATFORMS, key=lambda p: r[f"plat_{p}"])
    got = {r["cookie_id"]: r.asDict() for r in queries()["b24_relative"](spark, sf).collect()}
    assert len(families.RELATIVE_BASE) == 20 and got.keys() == {r["cookie_id"] for r in base}
    for r in base:
        mine = got[r["cookie_id"]]
        assert mine["dominant_platform"] == sorted(PLATFORMS).index(top(r))
        for c in families.RELATIVE_BASE:
            peers = [x[c] for x in base if x["is_fit"] and top(x) == top(r) and x[c] is not None]
            want = None if r[c] is None or not peers else sum(x <= r[c] for x in peers) / len(peers)
            assert mine[f"rel_plat_{c}"] == (want if want is None else pytest.approx(want, abs=1e-6)), c


def enriched(spark, *rows):
    return events.enrich(log(spark, *rows), Settings())


def agent(name):
    return (0, "login", {"user_agent": name})


@pytest.mark.parametrize(
    ("name", "family", "version", "device", "app"),
    [
        ("Mozilla/5.0 Version/17 Safari/605", "Safari", 605, None, None),
        ("Mozilla/5.0 HeadlessChrome/119 Safari/537", "HeadlessChrome", 119, None, None),
        ("Mozilla/5.0 Chrome/118 YaBrowser/23", "Chrome", 118, None, None),
        ("node-fetch/1.0", "node-fetch", None, None, None),
        ("python-urllib3/2.1", "python-urllib3", None, None, None),
        ("curly browser", "other", None, None, None),
        ("okhttp/4", "other", None, None, None),
        ("NativeApp/121 (Android 13; Pixel 6)", "NativeApp", None, "Pixel 6", 121),
        ("NativeApp/121 (iPhone; iOS 16.2; iPhone 14)", "NativeApp", None, "iPhone 14", 121),
        ("Old NativeApp/1", "other", None, None, None),
    ],
)
def test_user_agents(spark, name, family, version, device, app):
    row = families.user_agent_facts(enriched(spark, agent(name)), Settings()).first()
    assert (row["family"], row["browser_version"], row["device"], row["app_version"]) == (family, version, device, app)


def test_devices_and_scripts_are_counted(spark):
    row = families.client(enriched(spark, agent("node-fetch/1.0"), agent("NativeApp/1 (Android 13; Pixel 6)")), Settings()).first()
    assert row["ua_script_rate"] == 0.5 and row["uafam_node-fetch"] == 0.5 and row["ua_device_freq"] == 1 and row["ua_os_version"] == 13


def test_the_only_pointer_event_has_no_path(spark):
    row = families.pointer_deep(enriched(spark, (0, "login", {"pointer_x": 3.0, "pointer_y": 3.0})), Settings()).first()
    assert row["ptrd_path_len"] is None and row["ptrd_straightness"] is None and row["ptrd_bbox_fill"] == 0 and row["ptrd_edge_share"] == 0


def test_pointer_box_and_edges(spark):
    at = lambda x, y: {"pointer_x": x, "pointer_y": y}
    row = families.pointer_deep(enriched(spark, (0, "login", at(0.0, 540.0)), (1, "login", at(960.0, 540.0)), (2, "login", at(960.0, 1080.0)), (3, "login", at(5.0, 500.0))), Settings()).first()
    assert row["ptrd_bbox_fill"] == pytest.approx(960 * 580 / (1920 * 1080)) and row["ptrd_edge_share"] == 0.5
    assert row["ptrd_straightness"] == pytest.approx((25 + 1600) ** 0.5 / (row["ptrd_path_len"] + 1))


def test_visitors_without_searches_or_items(spark):
    ev = enriched(spark, (0, "login"), (5, "login"))
    row = families.pagination(ev, Settings()).first()
    assert row["page_step_up_count"] == 0 and row["page_mean"] is None and row["page_run_max"] is None and row["queries_nuniq"] is None
    row = families.navigation(ev, Settings()).first()
    assert row["item_revisit_max"] is None and row["swipe_run_max"] == 0


def test_the_first_item_has_no_step(spark):
    items = [(i, "item_view", {"item_id": x}) for i, x in enumerate((5, 9, 3))]
    assert families.id_structure(enriched(spark, *items), Settings()).first()["idst_up_share"] == 0.5


def test_last_event_is_measured_from_the_window_s_end(spark):
    meta = spark.createDataFrame([(1, T0, T0, T0 + timedelta(days=1))], "cookie_id long, cookie_created_at timestamp_ntz, window_start_ts timestamp_ntz, window_end_ts timestamp_ntz")
    row = families.window_coverage(enriched(spark, (3600, "login"), (7200, "login")), meta, Settings()).first()
    assert (row["first_event_offset_h"], row["last_event_offset_h"]) == (1, 22)


def test_pages_without_a_query_have_no_usual_depth(spark):
    rows = [(0, "search_results_view", {"search_page": 1, "search_query": "q"}), (1, "search_results_view", {"search_page": 9})]
    row = families.crowd(enriched(spark, *rows), Settings()).first()
    assert (row["crowd_page_mean"], row["crowd_page_max"]) == (0, 0)


@pytest.mark.parametrize("value", ["o'reilly", 'say "x"', "a.b", "back\\slash", "per%cent", "tick`"])
def test_values_with_any_character_become_columns(spark, value):
    ev = enriched(spark, (0, "search_results_view", {"search_query": value, "search_page": 1}), (1, "search_results_view", {"search_query": "q", "search_page": 1}))
    got = families.catalog_shares(ev, Settings(), families.catalog_vocabulary(ev, Settings()))
    assert got.first().asDict() == {"cookie_id": 1, f"shq_{value}": 0.5, "shq_q": 0.5}


def test_caught_and_missed_gap_is_over_the_caught(spark):
    rows = spark.createDataFrame([(1, 3.0, 2.0), (1, 2.0, 4.0), (1, 1.0, 9.0), (0, 0.0, 1.0)], "y long, s double, v double")
    row = metrics.caught_and_missed(rows, ("v",)).first()
    assert (row["missed_mean"], row["caught_mean"], row["other_mean"]) == (None, 5.0, 1.0) or row["gap"] == pytest.approx(abs(row["missed_mean"] - row["caught_mean"]) / (row["caught_mean"] + 1e-6))


@pytest.mark.parametrize(("weight", "want"), [(0.0, [1.0, 2.0, 3.0]), (1.0, [3.0, 2.0, 1.0]), (0.25, [1.0, 2.0, 3.0])])
def test_reorder_by_weight(spark, weight, want):
    rows = spark.createDataFrame([(1, 1.0, 9.0, True), (2, 2.0, 8.0, True), (3, 3.0, 7.0, True), (4, 2.5, 0.0, False)], "id long, s double, r double, inside boolean")
    got = {r["id"]: r["score"] for r in metrics.subgroup_reorder(rows, weight).collect()}
    assert [got[i] for i in (1, 2, 3)] == want and got[4] == 2.5


def _easy(spark, n=120):
    return spark.range(n).select(F.col("id").alias("cookie_id"), (F.col("id") % 3 == 0).cast("int").alias("target"), F.expr("double(id % 3) + rand(1)").alias("good"), F.rand(2).alias("noise"), F.expr("id % 2 = 0").alias("even"), F.lit(1.0).alias("flat"))


def test_selection_inside_folds_and_repeated_folds(spark):
    rows = _easy(spark).cache()
    assert models.select_columns(rows, ["noise", "good"], 1) == ["good"]
    report, blended = models.repeated_cv(rows, ["noise", "good"], "linear", k=2, seeds=(1, 2), select=1)
    told = {r["metric"]: r for r in report.collect()}
    assert set(told) == set(metrics.METRICS) and told["roc_auc"]["n_groups"] == 2 and told["roc_auc"]["mean"] > 0.9 and told["roc_auc"]["blend"] > 0.9
    assert blended.count() == 120


def test_rounds_stop_early(spark):
    noise = _easy(spark).withColumn("target", (F.rand(5) < 0.5).cast("int")).cache()
    assert models.estimate_rounds(noise, ["noise"], k=2, most=12, patience=3) <= 9


def test_specialist_scores_its_subgroup_alone(spark):
    got = models.specialist_out_of_fold(_easy(spark).cache(), ["good", "flat"], "even", "linear", k=2)
    rows = got.collect()
    assert len(rows) == 120 and all((r["score"] is None) == (r["cookie_id"] % 2 == 1) for r in rows)


def test_strict_rebuild_knows_nothing_of_the_scored_days(spark):
    from clickloom.plans.features import strict_rebuild, strict_report
    from clickloom.sources import fixture

    sf = "/root/testdata/sf0.001"
    clicks, cookies = fixture.clicks(spark, sf), fixture.cookies(spark, sf)
    later = clicks.join(cookies.where("day_index >= 4").select("cookie_id"), "cookie_id", "left_semi")
    twice = clicks.unionByName(later.withColumn("event_id", F.col("event_id") + 10**9))
    one, two = ({r["cookie_id"]: r.asDict() for r in strict_rebuild(x, cookies, FIXTURE, 4, pool_days=4).where("is_fit").collect()} for x in (clicks, twice))
    same = [c for c in next(iter(one.values())) if not c.startswith(("ua_freq", "ua_device", "seq")) and c in next(iter(two.values()))]
    assert len(same) > 300 and all(one[k][c] == two[k][c] for k in one for c in same if not c.startswith("rel_plat_ua"))
    report = strict_report(clicks, cookies, FIXTURE, 4, columns=("n_events", "dt_q50"), learner="linear", seeds=(1,)).first()
    assert 0 <= report["roc_auc"] <= 1 and report["n_features"] == 2


def test_results_with_absent_columns_and_settings(spark, tmp_path):
    readers.append_results(spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4), ("b", 1, 0.9)], "name string, ts long, ap double"), f"{tmp_path}/r")
    rows = readers.read_results(spark, f"{tmp_path}/r", ("roc",))
    assert rows.where("roc IS NOT NULL").count() == 0
    assert [(r["name"], r["ap"]) for r in readers.report_table(rows, "ap").collect()] == [("b", 0.9), ("a", 0.4)]
    readers.write_settings(spark, {"maxDepth": 4, "stepSize": 0.1}, f"{tmp_path}/s")
    assert readers.read_settings(spark, f"{tmp_path}/s") == {"maxDepth": 4, "stepSize": 0.1}


def test_sequence_svd_matches_numpy(spark):
    import itertools
    import random

    import numpy as np

    rng = random.Random(3)
    texts = {i: [rng.choice("SIPL") for _ in range(rng.randrange(1, 30))] for i in range(60)} | {60: ["Z"]}
    fit_ids = [i for i in texts if i % 4]
    table = spark.createDataFrame([(i, t) for i, t in texts.items()], "cookie_id long, ordered array<string>")
    got = {r["cookie_id"]: r for r in sequences.sequence_svd(table, spark.createDataFrame([(i,) for i in fit_ids], "cookie_id long"), "ordered", "seqo", 2, components=3, min_docs=5, terms=12).collect()}
    grams = {i: [*t, *map(" ".join, itertools.pairwise(t))] for i, t in texts.items()}
    tf = {g: sum(grams[i].count(g) for i in fit_ids) for i in fit_ids for g in grams[i]}
    df = {g: sum(g in grams[i] for i in fit_ids) for g in tf}
    terms = sorted((g for g in tf if df[g] >= 5), key=lambda g: (-tf[g], g))[:12]
    idf = np.array([np.log((1 + len(fit_ids)) / (1 + df[g])) + 1 for g in terms])
    x = np.array([[1 + np.log(grams[i].count(g)) if g in grams[i] else 0 for g in terms] for i in texts]) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    v = np.linalg.svd(x[fit_ids], full_matrices=False)[2][:3].T
    v *= np.sign(v[np.abs(v).argmax(0), np.arange(3)])
    want = x @ v
    assert all(np.allclose([got[i][f"seqo_{k}"] for k in range(3)], want[i], atol=1e-8) for i in texts)
