"""The whole feature matrix: one enriched frame, all families, one row per visitor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..config import Settings
from ..functions.kernels import KEY, merge, side_by_side
from ..functions.storage import scratch, written, written_together
from ..operators import encoding as N
from ..operators import events as E
from ..operators import families as B
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import sequences as Q
from ..operators import validation as V


def prepare(events: DataFrame, cookies: DataFrame) -> DataFrame:
    """Events with known platforms, inside their visitor's window, each with its visitor's ``is_fit`` and ``pool``, if any."""
    return E.clip_to_window(E.normalise_platform(events), cookies, keep=tuple(c for c in ("is_fit", "pool") if c in cookies.columns))


def _vocabularies(ev: DataFrame, s: Settings) -> tuple[list[str], dict[str, list[str]]]:
    """The most frequent transitions and catalogue values of fit visitors, in one job."""
    tops = {"pair": B.top_bigrams(ev, s).select("pair", "n")} | {c: B.top_values(ev, c, k) for c, k in s.catalog_tops}
    named = [d.toDF("value", "n").select(F.lit(name).alias("field"), "value", "n") for name, d in tops.items()]
    rows = sorted(reduce(DataFrame.unionByName, named).collect(), key=lambda r: (-r["n"], r["value"]))  # a stated number a field
    found = {name: [r["value"] for r in rows if r["field"] == name] for name in tops}
    return found.pop("pair"), found


def build_features(events: DataFrame, cookies: DataFrame, settings: Settings) -> DataFrame:
    """``all_features``, of whose equal columns the first stays."""
    return _without_copies(all_features(events, cookies, settings))


def cleaned(features: DataFrame) -> DataFrame:
    """NaN and infinity are NULL, and of equal columns the first stays; the features are read twice."""
    return _without_copies(scrubbed(features))


def _without_copies(features: DataFrame) -> DataFrame:
    return N.drop_duplicate_columns(features, KEY, [c for c in features.columns if c != KEY])


def scrubbed(features: DataFrame) -> DataFrame:
    """NaN and infinity are NULL."""
    return N.scrub(features, [f.name for f in features.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))])


def all_features(events: DataFrame, cookies: DataFrame, settings: Settings) -> DataFrame:
    """Every family's columns for every visitor; a visitor without events has NULLs beside the meta columns.

    The enriched frame is kept while the families read it. Each family is written as a table of its own, several at a
    time: joining the families' plans would have every join analyse its side anew, as all come from one frame. These
    tables, which have a row per visitor, are joined and written without NaN and infinity, as the platform-relative
    columns read the result again. Vocabularies, term weights and ranks come from fit visitors alone. Columns are in the order of the source of
    this format, which decides what stays of equal ones. Popularity compares visitors of one ``pool``, a column of
    ``cookies``, or all of them.
    """
    s = settings
    ev = E.enrich(prepare(events, cookies), s).persist()
    scope = lambda names: E.enrich(ev.where(F.col("platform").isin(*names)), s)  # noqa: E731  gaps within the scope; still split by visitor
    web, mobile = scope(C.WEB), scope(C.MOBILE)
    bigrams, catalog = _vocabularies(ev, s)
    fit_ids = cookies.where("is_fit").select(KEY)
    plain = lambda *families: {f.__name__: (lambda f=f: f(ev, s)) for f in families}
    documents = Q.token_documents(ev, s).persist()
    svd = lambda column, prefix, words: Q.sequence_svd(documents, fit_ids, column, prefix, words, min_docs=s.svd_min_docs)
    families = {
        "mix": lambda: B.volume_and_mix(ev, s),
        "transitions": lambda: B.transitions(ev, s, bigrams),
        **plain(B.timing, B.sessions, B.content, B.pagination, B.pointer, B.client, B.id_structure, B.dt_granularity),
        "catalog": lambda: B.catalog_shares(ev, s, catalog),
        "popularity": lambda: B.popularity(ev, s, "pool" if "pool" in cookies.columns else "'all'"),
        **plain(B.crowd, B.conditional_timing, B.navigation),
        "web-pointer": lambda: B.scoped(web, s, "webp_", (B.pointer,)),
        **plain(B.pointer_deep),
        "mobile": lambda: B.scoped(mobile, s, "mob_", (B.timing, B.navigation)),
        "web-timing": lambda: B.scoped(web, s, "web_", (B.timing,)),
        **{f"bins-{n}": (lambda w=w, n=n: B.binned(ev, s, w, n)) for w, n in zip(s.bin_widths, s.bin_names)},
        **plain(Q.compression, B.irregular),
        "coverage": lambda: B.window_coverage(ev, cookies, s),
        "seqo": lambda: svd("ordered", "seqo", 3),
        "seqp": lambda: svd("paced", "seqp", 2),
        "meta": lambda: B.cookie_meta(cookies),
    }
    slowest = sorted(families, key=lambda name: name not in _SLOW)
    with scratch():  # the families' tables go when they are joined
        try:
            tables = dict(zip(slowest, written_together({f"features-{name}": families[name] for name in slowest})))
        finally:
            ev.unpersist()
            documents.unpersist()
        joined = written(scrubbed(side_by_side(cookies.select(KEY), *(tables[name] for name in families))), "features-joined", keep=True)
    return with_relative(joined, cookies)


def relative_base(events: DataFrame, cookies: DataFrame, settings: Settings) -> DataFrame:
    """The columns that ``relative`` compares, each from its family, with platform shares and ``is_fit``."""
    s = settings
    ev = E.enrich(prepare(events, cookies), s).persist()
    web = E.enrich(ev.where(F.col("platform").isin(*C.WEB)), s)
    plain = (B.volume_and_mix, B.timing, B.sessions, B.content, B.pagination, B.client, B.id_structure, B.dt_granularity, B.conditional_timing, B.navigation, B.pointer_deep)
    families = {f.__name__: (lambda f=f: f(ev, s)) for f in plain} | {"web-pointer": lambda: B.scoped(web, s, "webp_", (B.pointer,))}
    try:
        tables = written_together({f"relative-{name}": build for name, build in families.items()})
    finally:
        ev.unpersist()
    return merge(*tables).join(cookies.select(KEY, "is_fit"), KEY).select(KEY, "is_fit", *(f"plat_{p}" for p in C.PLATFORMS), *B.RELATIVE_BASE)


# Begun first, so that the others fill the cores beside them.
_SLOW = ("seqo", "seqp", "pointer_deep", "compression")


def with_relative(features: DataFrame, cookies: DataFrame) -> DataFrame:
    """The matrix with its platform-relative columns, which are a table of their own; the features are read twice."""
    used = features.select(KEY, *(f"plat_{p}" for p in C.PLATFORMS), *B.RELATIVE_BASE).join(cookies.select(KEY, "is_fit"), KEY)
    relative = B.relative(used)
    ranks = relative.select(KEY, *(c for c in relative.columns if c not in (KEY, "dominant_platform")), "dominant_platform")
    return features.join(written(ranks, "features-relative"), KEY, "left")


def strict_rebuild(events: DataFrame, cookies: DataFrame, settings: Settings, cut: int, pool_days: int | None = 7) -> DataFrame:
    """The matrix built anew for a cut in time, with ``is_fit``, ``target`` and ``day_index``.

    Only visitors of days before ``cut`` shape vocabularies, term weights, medians and ranks, and popularity compares
    visitors of one span of ``pool_days`` days (None: all), so nothing of the scored period reaches a feature.
    """
    split = V.strict_split(cookies, cut)
    if pool_days:
        split = split.withColumn("pool", F.floor(F.col("day_index") / pool_days))
    return build_features(events, split, settings).join(split.select(KEY, "is_fit", "target", "day_index"), KEY)


def strict_report(events: DataFrame, cookies: DataFrame, settings: Settings, cut: int, columns: tuple[str, ...] = (), learner: str = "gbt", seeds: tuple[int, ...] = (1, 2, 3), pool_days: int | None = 7, keep: str = "", drop: str = "") -> DataFrame:
    """The four metrics on the days from ``cut`` on, of models fitted on the days before: a bag of seeds by mean rank.

    ``keep`` and ``drop`` are patterns that choose among the columns.
    """
    rows = written(strict_rebuild(events, cookies, settings, cut, pool_days), "strict")
    used = list(columns) or [c for c in rows.columns if c not in (KEY, "is_fit", "target", "day_index", "dominant_platform")]
    used = MD.columns_like(used, keep, drop)
    fit, held = rows.where("is_fit").drop("is_fit"), rows.where("NOT is_fit AND target IS NOT NULL")
    scores = MD.bagged(fit, held, used, learner, seeds).join(held.select(KEY, F.col("target").cast("long").alias("y")), KEY)
    return M.score(scores.select("y", F.round("score", 12).alias("s"))).withColumn("n_features", F.lit(len(used)))
