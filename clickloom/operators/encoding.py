"""Categorical keys, smoothed target rates, and duplicate columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import KEY, beside, ref, running


def dominant_keys(ev: DataFrame, cookies: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Each visitor's most frequent value by column, ties to the least value, ``?`` for none."""
    out = cookies.select(KEY)
    for column, name in columns.items():
        counts = ev.where(F.col(column).isNotNull()).groupBy(KEY, column).agg(F.count("*").alias("c"))
        top = counts.groupBy(KEY).agg(F.min_by(column, F.struct((-F.col("c")).alias("c"), column)).alias(name))
        out = out.join(top, KEY, "left")
    return out.na.fill("?", list(columns.values()))


def fit_rates(rows: DataFrame, key: str, smoothing: float) -> DataFrame:
    """``rows(key, y)`` to key -> smoothed rate, with the prior beside it."""
    prior = rows.agg(F.avg("y").alias("prior"))
    sums = rows.groupBy(key).agg(F.sum("y").alias("pos"), F.count("y").alias("n"))
    return sums.join(F.broadcast(prior)).select(key, ((F.col("pos") + smoothing * F.col("prior")) / (F.col("n") + smoothing)).alias("rate"), "prior")


def encode(rows: DataFrame, key: str, is_fit: str, smoothing: float) -> DataFrame:
    """``rows`` (cookie_id, key, y, a flag) with ``rate``: fitted on flagged rows, the prior for values unseen there."""
    fitted = rows.where(is_fit).select(key, "y")
    prior = fitted.agg(F.avg("y").alias("_prior"))
    return rows.join(fit_rates(fitted, key, smoothing).drop("prior"), key, "left").join(F.broadcast(prior)).withColumn("rate", F.coalesce("rate", "_prior")).drop("_prior")


def encode_out_of_fold(rows: DataFrame, key: str, fold: str, smoothing: float) -> DataFrame:
    """Each row's rate from all folds but its own: totals less the own fold's sums, one aggregation by (key, fold)."""
    own = rows.groupBy(key, fold).agg(F.sum("y").alias("pos"), F.count("y").alias("n"))
    by_key, by_fold, all_ = Window.partitionBy(key), rows.groupBy(fold).agg(F.sum("y").alias("fpos"), F.count("y").alias("fn")), rows.agg(F.sum("y").alias("apos"), F.count("y").alias("an"))
    rest = own.withColumns({"rpos": F.sum("pos").over(by_key) - F.col("pos"), "rn": F.sum("n").over(by_key) - F.col("n")})
    rest = rest.join(F.broadcast(by_fold), fold).join(F.broadcast(all_))  # a row per fold; one row
    prior = F.try_divide((F.col("apos") - F.col("fpos")).cast("double"), (F.col("an") - F.col("fn")).cast("double"))
    rate = (F.col("rpos") + smoothing * prior) / (F.col("rn") + smoothing)
    return rows.join(rest.select(key, fold, rate.alias("rate")), [key, fold])


def encode_ordered(rows: DataFrame, key: str, is_fit: str, permutations: int = 4, prior: float = 0.5, weight: float = 1.0, seed: int = 42) -> DataFrame:
    """``rows`` (cookie_id, key, y, a flag) with ``rate``, a category's mean target among the rows before it.

    Flagged rows stand in the order of an MD5 of (seed, permutation, cookie_id), and each takes ``prior`` with ``weight``
    and the targets of its category that come before its own, so no row's label reaches its own value; the mean over
    permutations is taken. Other rows take all flagged ones of their category. A NULL category is one of its own; a NULL
    target counts for nothing.
    """
    y = F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("_y")
    told = rows.where(is_fit).select(KEY, key, y, F.col("y").isNotNull().cast("long").alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_perm"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_perm").cast("string"), F.col(KEY).cast("string"))).alias("_order")
    told = running(told.select("*", order), ("_order", KEY), {"_pos": "_y", "_seen": "_n"}, ("_perm", key))
    value = lambda pos, n: (pos + weight * prior) / (n + weight)
    own = told.groupBy(KEY).agg(F.avg(value(F.col("_pos") - F.col("_y"), F.col("_seen") - F.col("_n"))).alias("rate"))
    whole = rows.where(is_fit).groupBy(key).agg(F.sum(F.coalesce(F.col("y").cast("double"), F.lit(0.0))).alias("_pos"), F.count("y").alias("_n"))
    fitted = rows.where(is_fit).join(own, KEY)
    others = beside(rows.where(f"NOT ({is_fit})"), whole, (key,), "left").withColumn("rate", value(F.coalesce("_pos", F.lit(0.0)), F.coalesce("_n", F.lit(0)))).drop("_pos", "_n")
    return fitted.unionByName(others)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_digests(df: DataFrame, key: str, columns: list[str]) -> dict[str, int]:
    """A digest of the (key, value) rows of each column, free of their order; NULL is a value, -0 is 0, NaN is one value."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(columns), np.uint64)
        for batch in batches:
            keys = _mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            for i in range(len(columns)):
                column = batch.column(i + 1)
                values = column.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
                bits = np.where(np.isnan(values), np.nan, values).view(np.uint64)
                bits = np.where(column.is_null().to_numpy(zero_copy_only=False), np.uint64(0x7FF0DEADBEEF0001), bits)
                sums[i] ^= np.bitwise_xor.reduce(_mixed(keys ^ _mixed(bits))) if len(bits) else np.uint64(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(columns), dtype=np.int32)), pa.array(sums.view(np.int64))], names=["i", "d"])

    rows = df.select(F.xxhash64(ref(key)), *(ref(c).cast("double") for c in columns)).toDF("k", *(f"c{i}" for i in range(len(columns))))
    told = rows.mapInArrow(scan, "i int, d long").groupBy("i").agg(F.bit_xor("d").alias("d"))
    return {columns[r["i"]]: r["d"] for r in told.collect()}  # a row a column


def duplicate_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(name, first): columns equal row by row to an earlier one.

    One pass takes a digest of each column; only columns of equal digest are compared.
    """
    row = column_digests(df, key, columns)
    seen: dict[int, list[str]] = {}
    pairs = []
    for c in columns:
        pairs += [(c, f) for f in seen.get(row.get(c, 0), [])]
        seen.setdefault(row.get(c, 0), []).append(c)
    schema = "name string, first string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    same = df.agg(*(F.bool_and(ref(a).cast("double").eqNullSafe(ref(b).cast("double"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first()
    first: dict[str, str] = {}
    for i, (a, b) in enumerate(pairs):
        if same[f"p{i}"]:
            first.setdefault(a, b)
    return df.sparkSession.createDataFrame(sorted(first.items()), schema)


def drop_duplicate_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.drop(*(r["name"] for r in duplicate_columns(df, key, columns).collect()))


def scrub(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinity become NULL."""
    clean = lambda c: F.when(F.isnan(ref(c)) | (F.abs(ref(c)) == float("inf")), None).otherwise(ref(c))
    return df.withColumns({c: clean(c) for c in columns})
