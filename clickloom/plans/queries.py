"""Registered queries of the click engine: an operator each, over the fixture's click log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.kernels import KEY, merge, ref, rounded, summarise
from ..operators import analysis as A
from ..operators import covisits as CV
from ..operators import encoding as N
from ..operators import events as E
from ..operators import families as B
from ..operators import metrics as M
from ..operators import reports as R
from ..operators import resampling as RS
from ..operators import sequences as Q
from ..operators import shapes as SH
from ..operators import validation as V
from ..sources import fixture, readers
from .features import build_features, prepare, relative_base

S = C.FIXTURE
STATED = (*B.RELATIVE_BASE, *(f"rel_plat_{c}" for c in B.RELATIVE_BASE), "dominant_platform")
Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and whole numbers as longs, so that results compare between engines."""
    out = []
    for f in df.schema.fields:
        c = ref(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = rounded(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def _clipped(spark: SparkSession, d: str) -> DataFrame:
    return prepare(fixture.clicks(spark, d), fixture.cookies(spark, d))


def _enriched(spark: SparkSession, d: str, platforms: tuple[str, ...] = ()) -> DataFrame:
    rows = _clipped(spark, d)
    return E.enrich(rows.where(F.col("platform").isin(*platforms)) if platforms else rows, S)


def _family(f: Callable, **more) -> Query:
    return lambda spark, d: f(_enriched(spark, d), S, **more)


def _pairs_with_shares(spark: SparkSession, d: str) -> DataFrame:
    ev = _enriched(spark, d)
    vocabulary = [r["pair"] for r in B.top_bigrams(ev, S).collect()]
    wide = B.transitions(ev, S, vocabulary).where("n_bigrams_uniq > 0")
    columns = {x: f"bg_{x}" for x in vocabulary}
    parts = F.explode(F.array(*(F.struct(F.lit(x).alias("pair"), ref(c).alias("share")) for x, c in columns.items()))).alias("x")
    return wide.select(KEY, "self_loop_rate", "n_bigrams_uniq", "bigram_entropy", parts).select(KEY, "x.*", "self_loop_rate", "n_bigrams_uniq", "bigram_entropy")


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    ev = _enriched(spark, d)
    vocabulary = B.catalog_vocabulary(ev, S)
    wide, names = B.catalog_shares(ev, S, vocabulary), dict(S.catalog_names)
    parts = [F.struct(F.lit(c).alias("field"), F.lit(v).alias("value"), ref(f"{names[c]}_{v}").alias("share")) for c, values in vocabulary.items() for v in values]
    return wide.select(KEY, F.explode(F.array(*parts)).alias("x")).select(KEY, "x.*")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents ranked by a coarse length, so that scores tie."""
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("y"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    rows = docs.join(labels, "doc_id").withColumnRenamed("doc_id", "id")
    return rows.withColumns({"s": F.expr("double(floor(n_chars / 200))"), "s2": F.expr("double(floor(n_chars / 1000) % 7)")})


def _unit(spark: SparkSession, d: str) -> DataFrame:
    """The same rows with a score in [0, 1]."""
    return scored(spark, d).select("y", F.expr("n_chars / (n_chars + 1000)").alias("s"))


def _rank_average(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    bags = rows.select("id", F.lit("a").alias("bag"), F.col("s"), F.lit(2.0).alias("w")).unionByName(rows.select("id", F.lit("b").alias("bag"), F.col("s2").alias("s"), F.lit(1.0).alias("w")))
    return M.rank_average(bags)


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return fixture.cookies(spark, d).select(KEY, F.col("target").alias("y"), "is_fit", F.expr("cookie_id % 5").alias("fold"), F.expr("concat('h', cookie_id * 7 % 9)").alias("k"))


def _portrait(spark: SparkSession, d: str) -> DataFrame:
    rows = _clipped(spark, d)
    got = summarise(rows, {"n_events": "count(*)", "pointer_coverage": "avg(double(pointer_x IS NOT NULL))", "n_items": "count(DISTINCT item_id)"})
    return R.portrait(got.join(fixture.cookies(spark, d).select(KEY, "target"), KEY), ("n_events", "pointer_coverage", "n_items"))


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = B.volume_and_mix(_enriched(spark, d), S).select(KEY, "n_events", "n_active_hours", "hour_entropy")
    return N.duplicate_columns(rows.withColumns({"a_copy": F.col("n_events"), "n_hours_copy": F.col("n_active_hours")}), KEY, ["n_events", "n_active_hours", "hour_entropy", "a_copy", "n_hours_copy"])


def _svd(column: str, prefix: str, words: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        documents = Q.token_documents(_enriched(spark, d), S)
        return Q.sequence_svd(documents, fixture.cookies(spark, d).where("is_fit").select(KEY), column, prefix, words, min_docs=5)

    return run


def _checks(spark: SparkSession, d: str) -> DataFrame:
    wanted = fixture.cookies(spark, d).where("NOT is_fit").select(KEY)
    return readers.check_scores(wanted.withColumn("score", F.expr("cookie_id / (cookie_id + 1000D)")), wanted)


def _top_customers(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    spent = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    rows = spent.join(read("customer").select("c_custkey", "c_nationkey"), "c_custkey").join(F.broadcast(read("nation").select("n_nationkey", F.col("n_name").alias("nation"))), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    place = F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("total"), "c_custkey"))
    return rows.withColumn("k", place).where("k <= 3").select("nation", "c_custkey", rounded("total", 2).alias("total"))


def _url_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/pages.parquet").select(F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), "url")
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.expr("count_if(contains(url, 'utm_'))").alias("n_tracked"))


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return build_features(fixture.clicks(spark, d), fixture.cookies(spark, d), S)


#: Scores that the agreement of metrics is measured over.
MODELS = {"a": "s", "b": "s2", "c": "-s", "d": "s + 3 * s2", "e": "n_chars % 500", "f": "-s2", "g": "s % 5 - s2"}


def _agreement(spark: SparkSession, d: str) -> DataFrame:
    each = scored(spark, d).select("id", "y", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.expr(e).cast("double").alias("s")) for m, e in MODELS.items()))).alias("x"))
    return RS.surrogate_agreement(RS.of_models(each.select("id", "y", "x.*"), RS.hashed_halves(42), 120))


def _drift(spark: SparkSession, d: str) -> DataFrame:
    ev = _enriched(spark, d)
    rows = merge(B.volume_and_mix(ev, S), B.timing(ev, S)).join(fixture.cookies(spark, d).select(KEY, (~F.col("is_fit")).alias("scored")), KEY)
    return SH.column_drift(rows, ("n_events", "n_active_hours", "hour_entropy", "rate_item_view", "night_rate", "dt_q50", "dt_iqr"), "scored")


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """The matrix' columns that do not hang on the data's values: compared columns, and their ranks within the platform."""
    found = feature_matrix(spark, d)
    return found.select(KEY, *(c for c in STATED if c in found.columns))


def queries() -> dict[str, Query]:
    cookies, clicks = fixture.cookies, fixture.clicks
    slices = {"all": "TRUE", "english": "lang = 'en'", "other": "lang <> 'en'", "long": "n_chars > 3000"}
    found: dict[str, Query] = {
        "clip_window": lambda s, d: summarise(_clipped(s, d), {"n_events": "count(*)", "first_ts": "min(event_ts)", "last_ts": "max(event_ts)"}),
        "platform_norm": lambda s, d: E.normalise_platform(clicks(s, d)).groupBy("platform").agg(F.count("*").alias("n")),
        "late_share": lambda s, d: E.window_profile(clicks(s, d), cookies(s, d)),
        "b01_volume_mix": _family(B.volume_and_mix),
        "top_bigrams": _family(B.top_bigrams),
        "b02_transitions": _pairs_with_shares,
        "b03_timing": _family(B.timing),
        "b04_sessions": _family(B.sessions),
        "b05_content": _family(B.content),
        "b06_pagination": _family(B.pagination),
        "b07_pointer": _family(B.pointer),
        "b08_client": _family(B.client),
        "b09_id_structure": _family(B.id_structure),
        "b10_dt_granularity": _family(B.dt_granularity),
        "b11_catalog_shares": _catalog,
        "b12_popularity": _family(B.popularity),
        "b13_crowd": _family(B.crowd),
        "b14_dwell": _family(B.conditional_timing),
        "b15_navigation": _family(B.navigation),
        "b16_pointer_web": lambda s, d: B.scoped(_enriched(s, d, C.WEB), S, "webp_", (B.pointer,)),
        "b17_pointer_deep": _family(B.pointer_deep),
        "b18_mobile_timing": lambda s, d: B.scoped(_enriched(s, d, C.MOBILE), S, "mob_", (B.timing,)),
        "b18_mobile_navigation": lambda s, d: B.scoped(_enriched(s, d, C.MOBILE), S, "mob_", (B.navigation,)),
        "b19_web_timing": lambda s, d: B.scoped(_enriched(s, d, C.WEB), S, "web_", (B.timing,)),
        **{f"b20_bins_{i}": _family(B.binned, width=w, prefix=n) for i, (w, n) in enumerate(zip(S.bin_widths, S.bin_names), 1)},
        "b20_compression": _family(Q.compression),
        "b20_irregular": _family(B.irregular),
        "b21_coverage": lambda s, d: B.window_coverage(_enriched(s, d), cookies(s, d), S),
        "b22_sequence_svd": _svd("ordered", "seqo", 3),
        "b22_sequence_svd_paced": _svd("paced", "seqp", 2),
        "b23_cookie_meta": lambda s, d: B.cookie_meta(cookies(s, d)),
        "b24_relative": lambda s, d: B.relative(relative_base(clicks(s, d), cookies(s, d), S)),
        "b25_covisitation": _family(CV.covisitation),
        "b26_class_shapes": lambda s, d: SH.class_shapes(_enriched(s, d), cookies(s, d).withColumn("fold", F.expr("int(cookie_id % 5)"))),
        "column_drift": _drift,
        "feature_matrix": feature_matrix,
        "feature_matrix_stated": _stated,
        "dup_columns": _duplicates,
        "dominant_keys": lambda s, d: N.dominant_keys(_clipped(s, d), cookies(s, d), {"user_agent": "key_ua", "item_category": "key_category", "item_location": "key_location"}),
        "target_encoding": lambda s, d: N.encode(_keyed(s, d), "k", "is_fit", S.smoothing).select(KEY, "rate"),
        "target_encoding_oof": lambda s, d: N.encode_out_of_fold(_keyed(s, d), "k", "fold", S.smoothing).select(KEY, "fold", "rate"),
        "target_encoding_ordered": lambda s, d: N.encode_ordered(_keyed(s, d), "k", "is_fit").select(KEY, "rate"),
        "pr_curve": lambda s, d: M.pr_curve(scored(s, d)).select("s", "tp", "fp", "precision", "recall"),
        "p_at_r70": lambda s, d: M.precision_at_recall(scored(s, d), S.target_recall),
        "recall_at_fpr": lambda s, d: M.recall_at_fpr(scored(s, d)),
        "roc_auc": lambda s, d: M.roc_auc(scored(s, d)),
        "average_precision": lambda s, d: M.average_precision(scored(s, d)),
        "score_bundle": lambda s, d: M.score(scored(s, d), S.target_recall),
        "rank_average": _rank_average,
        "minmax_rescale": lambda s, d: M.minmax(scored(s, d)),
        "blend_weights": lambda s, d: M.blend_weights(scored(s, d).select("y", (F.col("s") / 100).alias("one"), (F.col("s2") / 7).alias("two")), ("one", "two")),
        "regime_slices": lambda s, d: M.regime_slices(scored(s, d), slices),
        "caught_vs_missed": lambda s, d: M.caught_and_missed(scored(s, d), ("n_chars", "s2", "s")),
        "reliability": lambda s, d: A.reliability(_unit(s, d)),
        "likelihood_ratios": lambda s, d: A.likelihood_ratios(scored(s, d), "n_chars", (500.0, 1000.0, 2000.0, 5000.0)),
        "prevalence_resample": lambda s, d: A.at_prevalence(scored(s, d).select("id", "y"), 0.2),
        "draw_spread": lambda s, d: A.spread_over_draws(scored(s, d), 0.5, 20),
        "bootstrap_spread": lambda s, d: RS.bootstrap(scored(s, d)),
        "surrogate_agreement": _agreement,
        "subgroup_reorder": lambda s, d: M.subgroup_reorder(scored(s, d).select("id", "s", F.col("s2").alias("r"), F.expr("lang <> 'en'").alias("inside")), 0.5),
        "fold_spread": lambda s, d: M.metric_spread(scored(s, d).withColumn("fold", F.col("id") % 5), "fold"),
        "subgroup_columns": lambda s, d: M.subgroup_columns(_clipped(s, d).where(F.col("platform").isin(*C.MOBILE)), ("item_id", "search_page", "pointer_x", "seller_type", "platform")),
        "forward_chain_splits": lambda s, d: V.forward_chain(cookies(s, d)),
        "stratified_folds": lambda s, d: V.stratified_folds(cookies(s, d)),
        "strict_split": lambda s, d: V.strict_split(cookies(s, d), 4).groupBy("is_fit").agg(F.count("*").alias("n"), F.sum("target").alias("n_pos")),
        "recency_weights": lambda s, d: V.recency_weights(cookies(s, d), 3.0),
        "submission_checks": _checks,
        "eda_value_counts": lambda s, d: R.value_counts(clicks(s, d), "event_name"),
        "eda_missing": lambda s, d: R.missing_shares(clicks(s, d), ("item_id", "search_page", "pointer_x", "seller_type")),
        "eda_portrait": _portrait,
        "windows_per_day": lambda s, d: R.windows_per_day(cookies(s, d)),
        "basic_features": lambda s, d: R.basic_features(_clipped(s, d), cookies(s, d)),
        "dedup_keep_first": lambda s, d: V.keep_first(clicks(s, d), KEY, "event_id").select(KEY, "event_id"),
        "dedup_keep_last": lambda s, d: V.keep_first(clicks(s, d), KEY, "event_id", last=True).select(KEY, "event_id"),
        "set_ops": lambda s, d: R.id_overlap(cookies(s, d).where("is_fit"), cookies(s, d).where("target = 1")),
        "url_parts": _url_parts,
        "top_customers": _top_customers,
    }
    return {name: (lambda s, d, f=f: tidy(f(s, d))) for name, f in found.items()}
