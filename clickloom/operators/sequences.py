"""Event sequences: compressibility, and truncated SVD of TF-IDF weights."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import NGram
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EVENT_CODES, Settings
from ..functions.kernels import KEY
from ..functions.storage import written


def _letters(cuts: tuple[int, ...], of: str = "dt", names: str = "abcdefgh") -> str:
    steps = " ".join(f"WHEN {of} <= {c} THEN '{n}'" for c, n in zip(cuts, names))
    return f"CASE {steps} ELSE '{names[len(cuts)]}' END"


def streams(ev: DataFrame, s: Settings) -> DataFrame:
    """Ordered symbol streams per visitor. Missing values are written ``nan``, as in the source of this format."""
    pace = f"CASE WHEN dt IS NULL THEN 'nan' ELSE {_letters(s.compression_cuts)} END"
    symbol = F.struct(
        "event_ts",
        "event_id",
        F.substring("event_name", 1, 3).alias("event"),
        F.substring(F.coalesce("item_category", F.lit("nan")), 1, 3).alias("category"),
        F.substring(F.coalesce("item_location", F.lit("nan")), 1, 3).alias("location"),
        F.concat(F.substring("event_name", 1, 2), F.expr(pace)).alias("paced"),
    )
    rows = ev.groupBy(KEY).agg(F.sort_array(F.collect_list(symbol)).alias("x"))
    return rows.select(KEY, *(F.array_join(F.col("x").getField(k), "").alias(k) for k in ("event", "category", "location", "paced")))


@F.pandas_udf(T.DoubleType())
def gzip_ratio(text: pd.Series) -> pd.Series:
    """Length of the gzip stream (level 6) over the length of the text; NULL for none."""

    def one(t: str | None) -> float | None:
        if not t:
            return None
        raw = t.encode()
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return (len(z.compress(raw)) + len(z.flush())) / len(raw)

    return text.map(one)


def compression(ev: DataFrame, s: Settings) -> DataFrame:
    return streams(ev, s).select(KEY, *(gzip_ratio(c).alias(f"cmp_{c}") for c in ("event", "category", "location", "paced")))


def token_documents(ev: DataFrame, s: Settings) -> DataFrame:
    """``ordered``: a letter code per event; ``paced``: the code with the gap's bucket, ``nan`` for the first event."""
    code = F.create_map(*(F.lit(x) for kv in EVENT_CODES.items() for x in kv))[F.col("event_name")]
    pace = f"CASE WHEN dt IS NULL THEN 'nan' ELSE {_letters(s.pace_cuts, names="01234")} END"
    rows = ev.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("event_ts", "event_id", code.alias("o"), F.concat(code, F.expr(pace)).alias("p")))).alias("x"))
    return rows.select(KEY, F.col("x").getField("o").alias("ordered"), F.col("x").getField("p").alias("paced"))


def sequence_svd(documents: DataFrame, fit_ids: DataFrame, column: str, prefix: str, most_words: int, components: int = 8, min_docs: float = 20, terms: int = 400) -> DataFrame:
    """Truncated SVD of smoothed TF-IDF of word n-grams, fitted on ``fit_ids``; signs make the largest loading positive.

    The terms are the ``terms`` most frequent n-grams of ``min_docs`` fit documents or more. Weights are
    (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), then each row has length 1. All is NULL if there is no such term.

    N-grams are counted once per visitor and written. The terms and the Gram matrix, terms by terms and so bounded, come
    to the driver; its eigenvectors are the right singular vectors.
    """
    rows = documents.select(KEY, column)
    for n in range(1, most_words + 1):
        rows = NGram(n=n, inputCol=column, outputCol=f"g{n}").transform(rows)
    grams = rows.select(KEY, F.explode(F.concat(*(f"g{n}" for n in range(1, most_words + 1)))).alias("gram"))
    fit_rows = fit_ids.select(KEY).distinct().withColumn("is_fit", F.lit(True))
    counted = written(grams.groupBy(KEY, "gram").agg(F.count("*").alias("c")).join(fit_rows, KEY, "left"), f"{prefix}-grams")
    known = counted.where("is_fit").groupBy("gram").agg(F.count("*").alias("df"), F.sum("c").alias("tf"))
    found = known.where(F.col("df") >= min_docs).orderBy(F.desc("tf"), "gram").limit(terms).collect()
    names = [f"{prefix}_{k}" for k in range(components)]
    if not found:
        return documents.select(KEY, *(F.lit(None).cast("double").alias(n) for n in names))
    n_fit = documents.select(KEY).join(fit_rows, KEY, "left_semi").count()
    spark, width = documents.sparkSession, len(found)
    table = [(r["gram"], j, float(np.log((1 + n_fit) / (1 + r["df"])) + 1)) for j, r in enumerate(found)]
    vocabulary = F.broadcast(spark.createDataFrame(table, "gram string, j int, idf double"))  # ``terms`` rows
    weighed = counted.join(vocabulary, "gram").groupBy(KEY).agg(F.max("is_fit").alias("is_fit"), F.collect_list("j").alias("j"), F.collect_list(F.expr("(1 + ln(c)) * idf")).alias("w"))

    def dense(batch: pa.RecordBatch) -> np.ndarray:
        j, w = (batch.column(batch.schema.get_field_index(c)) for c in "jw")
        out = np.zeros((batch.num_rows, width))
        out[np.repeat(np.arange(batch.num_rows), np.diff(j.offsets.to_numpy())), j.flatten().to_numpy()] = w.flatten().to_numpy()
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def gram_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            block = dense(batch)
            total += block.T @ block
        at = np.flatnonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "value"])

    parts = weighed.where("is_fit").select("j", "w").mapInArrow(gram_parts, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    gram = np.zeros(width * width)
    for r in parts.toLocalIterator():  # at most terms x terms / 2 rows
        gram[r["at"]] = r["value"]
    gram = gram.reshape(width, width)
    v = np.linalg.eigh(np.triu(gram) + np.triu(gram, 1).T)[1][:, ::-1][:, : min(components, width)]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = dense(batch) @ v
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, k]) for k in range(got.shape[1]))], names=[KEY, *names[: got.shape[1]]])

    schema = T.StructType([documents.schema[KEY], *(T.StructField(n, T.DoubleType()) for n in names[: v.shape[1]])])
    placed = documents.select(KEY).join(weighed.select(KEY, "j", "w").mapInArrow(project, schema), KEY, "left").na.fill(0.0, names[: v.shape[1]])
    return placed.select("*", *(F.lit(None).cast("double").alias(n) for n in names[v.shape[1] :]))
