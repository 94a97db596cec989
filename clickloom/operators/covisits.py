"""Whom a visitor meets on its items: the co-visitation graph as degrees, shared weights and overlaps, never as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.kernels import KEY, number_of, percent_ranks
from ..functions.storage import scratch, written

_MET = "visitor long, neighbours long, shared long, widest long, repeated long, jaccard_sum double, jaccard_max double"
#: Meetings, and places in a table of pairs, that a task holds at once.
_AT_ONCE = 1 << 20
#: A table of pairs may have so many places a meeting; sparser ones are sorted.
_SPARSE = 8


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each visitor of a cell meets there. Rows (cell, side, item, visitor, n_items) come cell by cell; one is held."""
    held: list[list[np.ndarray]] = []
    open_cell = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        cell = columns[0]
        edges = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if held and cell[a] != open_cell:
                yield from _of_cell(*(np.concatenate(x) for x in zip(*held)))
                held = []
            open_cell = cell[a]
            held.append([x[a:b].copy() for x in columns[1:]])
    if held:
        yield from _of_cell(*(np.concatenate(x) for x in zip(*held)))


def _of_cell(side: np.ndarray, item: np.ndarray, visitor: np.ndarray, n_items: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of a cell's visitors. Some visitors at a time meet all of the other side, or of a block's own rows, and are
    summed at once: so memory hangs on the cell's rows and on ``_AT_ONCE``, never on its meetings."""
    names, number = np.unique(visitor, return_inverse=True)
    size = np.zeros(len(names), np.int64)
    size[number] = n_items
    one_sided = side.max() == 0
    here = np.ones(len(item), bool) if one_sided else side == 1
    there = here if one_sided else ~here
    # those who are met, by item; those who meet, by visitor
    order = np.argsort(item[there], kind="stable")
    met_item, met_number = item[there][order], number[there][order]
    order = np.argsort(number[here], kind="stable")
    item, number = item[here][order], number[here][order]
    first = np.searchsorted(met_item, item)
    take = np.searchsorted(met_item, item, "right") - first
    starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else np.empty(0, np.int64)
    if not len(starts):
        return
    upto = np.cumsum(np.add.reduceat(take, starts))  # meetings of the visitors so far
    ends, n = np.append(starts[1:], len(number)), len(names)
    neighbours, shared, widest, repeated = (np.zeros(n, np.int64) for _ in range(4))
    jaccard_sum, jaccard_max = np.zeros(n), np.zeros(n)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _AT_ONCE, "right")))
        rows = slice(starts[at], ends[stop - 1])
        for a, b, count in _counted(number[rows], first[rows], take[rows], met_number, n):
            if one_sided:  # a pair is met from both ends, and each visitor meets itself
                a, b, count = (x[a != b] for x in (a, b, count))
            jaccard = count / (size[a] + size[b] - count)
            for me in (a,) if one_sided else (a, b):
                neighbours += np.bincount(me, minlength=n)
                shared += np.bincount(me, count, n).astype(np.int64)
                repeated += np.bincount(me, count > 1, n).astype(np.int64)
                jaccard_sum += np.bincount(me, jaccard, n)
                np.maximum.at(widest, me, count)
                np.maximum.at(jaccard_max, me, jaccard)
        at = stop
    met = np.flatnonzero(neighbours)
    if len(met):
        told = [names[met], *(x[met] for x in (neighbours, shared, widest, repeated, jaccard_sum, jaccard_max))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in told], names=["visitor", "neighbours", "shared", "widest", "repeated", "jaccard_sum", "jaccard_max"])


def _counted(number: np.ndarray, first: np.ndarray, take: np.ndarray, met_number: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(visitor, met visitor, items in common) of whole visitors; one who alone has more meetings is counted in a row of ``n``."""
    total, visitors = int(take.sum()), np.unique(number)
    if len(visitors) == 1 and total > _AT_ONCE:
        counts, at, upto = np.zeros(n, np.int64), 0, np.cumsum(take)
        while at < len(take):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _AT_ONCE, "right")))
            counts += np.bincount(met_number[_spans(first[at:stop], take[at:stop])], minlength=n)
            at = stop
        b = np.flatnonzero(counts)
        yield np.full(len(b), visitors[0]), b, counts[b]
        return
    if not total:
        return
    place = np.searchsorted(visitors, number)
    code = np.repeat(place * n, take) + met_number[_spans(first, take)]
    if len(visitors) * n <= _SPARSE * total:
        counts = np.bincount(code, minlength=len(visitors) * n)
        code = np.flatnonzero(counts)
        counts = counts[code]
    else:
        code, counts = np.unique(code, return_counts=True)
    yield visitors[code // n], code % n, counts


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i], ..., first[i] + n[i] - 1 of every i, one behind the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def blocks_for(n_rows: int, n_meetings: int, cell_rows: int = 500_000, cell_meetings: int = 16_000_000) -> int:
    """Into how many blocks visitors are dealt, so that a cell of two blocks has about so many rows and meetings."""
    return max(1, int(np.ceil(max(2 * n_rows / cell_rows, (n_meetings / cell_meetings) ** 0.5))))


def covisitation(ev: DataFrame, s: Settings, pool: str = "'all'", blocks: int | None = None) -> DataFrame:
    """One row per visitor with an item: columns ``cv_*`` of the graph in which visitors of one item are neighbours.

    cv_degree neighbours; cv_shared_max, _mean, _sum of the items shared with each; cv_deg_per_item; cv_repeat, the share
    of neighbours with more than one item in common; cv_jaccard_max, _mean of item sets; and for degree, degree per item
    and mean shared weight the percentile inside the pool. Without a neighbour degrees and sums are 0 and the rest NULL.

    Visitors are dealt into blocks by a hash. The rows of two blocks that share items form a cell, where all of two
    visitors' common items meet, so overlaps are complete there and only sums by visitor leave it: an item of any audience
    is spread over the cells and no edge is written. The sums are written, as the percentiles read them several times.
    """
    with scratch():  # pairs go when the sums are written
        out = written(_sums(ev, pool, blocks), "covisits", keep=True)
    for name in ("cv_degree", "cv_deg_per_item", "cv_shared_mean"):
        out = percent_ranks(out, name, f"{name}_pct", ("pool",))
    return out.drop("pool")


def _sums(ev: DataFrame, pool: str, blocks: int | None) -> DataFrame:
    pairs = written(ev.where("item_id IS NOT NULL").select(F.expr(pool).cast("string").alias("pool"), KEY, "item_id").distinct(), "covisits-pairs")
    own = pairs.groupBy("pool", KEY).agg(F.count("*").alias("n_items"))
    own = own.withColumn("visitor", number_of(own, KEY))
    items = pairs.groupBy("pool", "item_id").agg(F.count("*").alias("audience")).where("audience > 1")
    if blocks is None:
        told = items.agg(F.coalesce(F.sum("audience"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.expr("double(audience) * (audience - 1) / 2")), F.lit(0.0)).alias("m")).first()
        blocks = blocks_for(int(told["n"]), int(told["m"]))
    shared = pairs.join(items.select("pool", "item_id"), ["pool", "item_id"]).join(own, ["pool", KEY])
    shared = shared.withColumn("block", F.pmod(F.xxhash64(KEY, F.lit(25)), F.lit(blocks)).cast("int")).withColumn("item", F.xxhash64("pool", "item_id"))
    met_by = shared.select("pool", "item_id", F.col("block").alias("other")).distinct()
    rows = shared.join(met_by, ["pool", "item_id"])
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    cell = F.least("block", "other") * F.lit(blocks).cast("long") + F.greatest("block", "other")
    # an item's rank by hash is as good as its id; halved, as the side is put below it
    rows = rows.select(cell.alias("cell"), side.alias("side"), F.shiftright("item", 1).alias("item"), "visitor", "n_items")
    parts = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_meet, _MET)
    sums = parts.groupBy("visitor").agg(*(F.sum(c).alias(c) for c in ("neighbours", "shared", "repeated", "jaccard_sum")), *(F.max(c).alias(c) for c in ("widest", "jaccard_max")))
    return own.join(sums, "visitor", "left").select(
        KEY,
        "pool",
        F.coalesce("neighbours", F.lit(0)).alias("cv_degree"),
        F.col("widest").alias("cv_shared_max"),
        (F.col("shared") / F.col("neighbours")).alias("cv_shared_mean"),
        F.coalesce("shared", F.lit(0)).alias("cv_shared_sum"),
        (F.coalesce("neighbours", F.lit(0)) / F.col("n_items")).alias("cv_deg_per_item"),
        (F.col("repeated") / F.col("neighbours")).alias("cv_repeat"),
        F.col("jaccard_max").alias("cv_jaccard_max"),
        (F.col("jaccard_sum") / F.col("neighbours")).alias("cv_jaccard_mean"),
    )
