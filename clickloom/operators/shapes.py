"""A visitor's events against the two classes: how likely each value is among positives and among negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import KEY, beside, rounded, running

#: (group, value) of each channel as SQL over enriched events: values are binned within their group; a NULL does not count.
CHANNELS = {
    "gap": ("''", "log1p(dt)"),
    "pointer_x": ("''", "pointer_x"),
    "pointer_y": ("''", "pointer_y"),
    "page": ("''", "double(search_page)"),
    "minute": ("''", "double(minute(event_ts))"),
    "item_digits": ("string(item_id % 100)", "0D"),
    "event_name": ("event_name", "0D"),
    "platform": ("platform", "0D"),
    "category": ("item_category", "0D"),
    "location": ("item_location", "0D"),
    "query": ("search_query", "0D"),
    "seller": ("seller_type", "0D"),
    "hour": ("string(hour(event_ts))", "0D"),
    "event_x_gap": ("event_name", "log1p(dt)"),
    "platform_x_gap": ("platform", "log1p(dt)"),
    "event_x_page": ("event_name", "double(search_page)"),
}


def binned_values(ev: DataFrame, channels: dict[str, tuple[str, str]], bins: int = 24) -> DataFrame:
    """(channel, cookie_id, grp, bin, n): how many of a visitor's events lie in each bin of each channel.

    A bin is told by the share of fit visitors' events of its channel and group below the value, so bins hold equal
    parts of those. All channels share one count by (channel, group, value, visitor) and one running sum over distinct
    values. ``ev`` has ``is_fit``; values agree to six digits.
    """
    parts = [F.struct(F.lit(name).alias("channel"), F.expr(g).alias("grp"), rounded(F.expr(v).cast("double"), 6).alias("v")) for name, (g, v) in channels.items()]
    long = ev.select(KEY, "is_fit", F.explode(F.array(*parts)).alias("x")).select(KEY, "is_fit", "x.*").where("grp IS NOT NULL AND v IS NOT NULL")
    own = long.groupBy("channel", "grp", "v", KEY, "is_fit").agg(F.count("*").alias("n"))
    values = own.groupBy("channel", "grp", "v").agg(F.coalesce(F.sum(F.when(F.col("is_fit"), F.col("n"))), F.lit(0)).alias("fit"))
    values = running(values, "v", {"upto": "fit"}, ("channel", "grp"))
    whole = values.groupBy("channel", "grp").agg(F.sum("fit").alias("all_fit"))
    below = F.try_divide(F.lit(bins) * (F.col("upto") - F.col("fit")), F.col("all_fit"))
    values = values.join(whole, ["channel", "grp"]).select("channel", "grp", "v", F.coalesce(F.least(F.floor(below), F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin"))
    return own.join(values, ["channel", "grp", "v"]).groupBy("channel", KEY, "grp", "bin").agg(F.sum("n").alias("n"))


def log_ratios(counts: DataFrame, known: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(channel, grp, bin, fold, llr): log P(bin | positive) - log P(bin | negative) from fit visitors of other folds.

    ``known`` is (cookie_id, fold, y) of fit visitors. Fold -1, for visitors without one, leaves nobody out. Totals less a
    fold's own counts come from one aggregation by fold; a bin counts ``smoothing`` events more in each class.
    """
    fit = counts.join(known, KEY)
    of = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0))
    cells = fit.groupBy("channel", "grp", "bin", "fold").agg(of(1).alias("pos"), of(0).alias("neg"))
    bins = cells.groupBy("channel", "grp", "bin").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    folds = cells.select("fold").distinct().unionByName(cells.sparkSession.range(1).select(F.lit(-1).cast("int").alias("fold")))
    every = bins.join(F.broadcast(folds))  # a row per fold
    rest = beside(every, cells, ("channel", "grp", "bin", "fold"), "left").select(
        "channel", "grp", "bin", "fold", (F.col("all_pos") - F.coalesce("pos", F.lit(0))).alias("pos"), (F.col("all_neg") - F.coalesce("neg", F.lit(0))).alias("neg")
    )
    sums = rest.groupBy("channel", "fold").agg(F.sum("pos").alias("s_pos"), F.sum("neg").alias("s_neg"), F.count("*").alias("k"))
    share = lambda n, total: F.log((F.col(n) + smoothing) / (F.col(total) + smoothing * F.col("k")))
    return rest.join(F.broadcast(sums), ["channel", "fold"]).select("channel", "grp", "bin", "fold", (share("pos", "s_pos") - share("neg", "s_neg")).alias("llr"))  # a row per channel and fold


def class_shapes(ev: DataFrame, cookies: DataFrame, channels: dict[str, tuple[str, str]] = CHANNELS, bins: int = 24, smoothing: float = 1.0) -> DataFrame:
    """(cookie_id, channel, mean, std, least, most, q10, q50, q90) of the log ratios of a visitor's own events.

    ``cookies`` has is_fit, target and fold. Fit visitors are scored without their own fold. The channel ``total`` has the
    mean over events of the sum of all channels, where an event lacks a channel's value as zero, and NULL else. Bins that
    no fit visitor met have a ratio of 0.
    """
    counts = binned_values(ev, channels, bins)
    known = cookies.where("is_fit AND target IS NOT NULL").select(KEY, F.col("fold").cast("int").alias("fold"), F.col("target").cast("int").alias("y"))
    ratios = log_ratios(counts, known, smoothing)
    placed = counts.join(known.select(KEY, "fold"), KEY, "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    scored = placed.join(ratios, ["channel", "grp", "bin", "fold"], "left").withColumn("llr", F.coalesce("llr", F.lit(0.0)))
    n, mean = F.sum("n"), F.sum(F.col("llr") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("llr") * F.col("llr") * F.col("n"))
    quantile = lambda p: F.expr(f"percentile(llr, {p}, n)")  # noqa: E731  at most a value per bin
    each = scored.groupBy(KEY, "channel").agg(
        mean.alias("mean"), F.sqrt(F.greatest(square / n - mean * mean, F.lit(0.0))).alias("std"), F.min("llr").alias("least"), F.max("llr").alias("most"), quantile(0.1).alias("q10"), quantile(0.5).alias("q50"), quantile(0.9).alias("q90"), F.sum(F.col("llr") * F.col("n")).alias("_sum")
    )
    total = each.groupBy(KEY).agg(F.sum("_sum").alias("_sum")).join(ev.groupBy(KEY).agg(F.count("*").alias("_n")), KEY)
    none = [F.lit(None).cast("double").alias(c) for c in ("std", "least", "most", "q10", "q50", "q90")]
    total = total.select(KEY, F.lit("total").alias("channel"), (F.col("_sum") / F.col("_n")).alias("mean"), *none)
    return each.drop("_sum").unionByName(total)


def column_drift(features: DataFrame, columns: tuple[str, ...], side: str) -> DataFrame:
    """(name, n_a, n_b, auc, missing_a, missing_b): how well each column alone tells rows of ``side`` from the others.

    ``auc`` is the share of (b, a) pairs of known values with the larger one in b, ties half. All columns are counted by
    (column, value) at once and share one running sum. Values agree to nine digits; NaN is the greatest.
    """
    long = features.select(F.col(side).alias("b"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), rounded(F.col(f"`{c}`").cast("double"), 9).alias("v")) for c in columns))).alias("x")).select("b", "x.*")
    counts = long.groupBy("name", "v").agg(F.count_if("b").alias("b"), F.count_if(~F.col("b")).alias("a"))
    curve = running(counts.where("v IS NOT NULL"), "v", {"upto_a": "a"}, ("name",))
    told = curve.groupBy("name").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("b") * (F.col("upto_a") - F.col("a") / 2)).alias("ahead"))
    gone = counts.groupBy("name").agg(*(F.try_divide(F.sum(F.when(F.col("v").isNull(), F.col(c)).otherwise(0)).cast("double"), F.sum(c).cast("double")).alias(f"missing_{c}") for c in ("a", "b")))
    auc = F.try_divide(F.col("ahead"), (F.col("n_a") * F.col("n_b")).cast("double"))
    return gone.join(told, "name", "left").select("name", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), auc.alias("auc"), "missing_a", "missing_b")
