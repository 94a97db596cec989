"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents stand in a shuffled queue, twice over. A document's virtual finish time is the cumulative
size of its source's queue divided by the source's weight. All finish times are sorted by range over the cluster,
and the mix ends where the running size reaches the budget: sources that run dry leave their share to the others
in proportion to their weights, as in a fair queue.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, attach, fresh_name, materialise

_START, _NOW = Window.unboundedPreceding, Window.currentRow


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _queue_key(seed: int) -> Column:
    """Shuffles: 32 hex digits of an MD5 of seed, doc_id and text, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes(key, source, source_size)`` with weight, rank and target.

    Sources by code point, null last, take the weights in turn and share ``share`` of all sizes; a target stops at
    ``most`` times its source's size and the excess is shared anew. With sources in the order of ``limit / weight``
    the ones that stop are a beginning of that order, so two running sums replace the rounds. One row a source.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("limit") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("ratio", "rank").rowsBetween(_START, -1)
    zero = F.lit(0.0)
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("spent", F.coalesce(F.sum("limit").over(before), zero))
        .withColumn("stops", F.col("ratio") * F.col("rest") + F.col("spent") <= F.col("budget"))
    )
    level = F.try_divide(
        F.col("budget") - F.sum(F.when(F.col("stops"), F.col("limit")).otherwise(zero)).over(every),
        F.sum(F.when(F.col("stops"), zero).otherwise(F.col("weight"))).over(every),
    )
    return ranked.withColumn("target", F.when(F.col("stops"), F.col("limit")).otherwise(level * F.col("weight"))).select(
        "key", "source_size", "rank", "weight", "target", "budget"
    )


def _sized(docs: DataFrame, seed: int, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with columns of the given names: source key, size, and the hash that shuffles."""
    key, size, h = names
    return docs.withColumns({key: F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), size: word_count(), h: _queue_key(seed)})


def queue(rows: DataFrame, weights: tuple[float, ...], share: float, laps: int) -> tuple[DataFrame, DataFrame]:
    """For ``rows(doc_id, source, key, size, h)``: the targets of the sources and where each source's laps end.

    Targets have a row per source. The ends have a row per source and lap: the last unit taken, ``last`` = (h, doc_id,
    size), and of the rows that are this unit the number taken, ``n_last``.

    Equal rows are counted first and stand one after another. Within a source the queue is cut by the leading bits of
    the hash, about the square root of the rows in number, so neither a hot source nor the table of cuts meets in one
    task. The document that reaches the budget is the last one taken.
    """
    bits = max(1, math.ceil(math.log2(max(1, rows.count())) / 2))
    cut = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - min(32, bits))
    units = materialise(rows.withColumn("cut", cut).groupBy("key", "cut", "h", "doc_id", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")), "mix-units")
    cuts = units.groupBy("key", "cut").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("part"))
    cuts = materialise(cuts, "mix-cuts")
    targets = source_targets(cuts.groupBy("key").agg(F.first("source").alias("source"), F.sum("part").alias("source_size")), weights, share, laps)
    targets = materialise(targets, "mix-targets")
    earlier = F.coalesce(F.sum("part").over(Window.partitionBy("key").orderBy("cut").rowsBetween(_START, -1)), F.lit(0))
    placed = attach(cuts.select("key", "cut", earlier.alias("earlier")), targets, ["key"], "mix-sources", row_bytes=120)
    queued = attach(units.where("size > 0"), placed, ["key", "cut"], "mix-places", row_bytes=120)
    inside = Window.partitionBy("key", "cut").orderBy("h", "doc_id", "size").rowsBetween(_START, -1)
    before = F.col("earlier") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
    queued = queued.withColumn("before", before).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    reached = F.col("before") + F.col("k") * F.col("size")
    finish = [(reached + lap * F.col("source_size")) / F.col("weight") for lap in range(laps)]
    queued = materialise(queued.select("key", "h", "doc_id", "size", "k", "budget", "rank", F.array(*finish).alias("finish")), "mix-queue")
    cut = _cut(queued)
    taken = F.lit(False) if cut is None else (F.col("time") < cut["finish"]) | ((F.col("time") == cut["finish"]) & (F.col("rank") <= cut["rank"]))
    laps_taken = queued.select("key", "h", "doc_id", "size", "k", "rank", F.posexplode("finish").alias("lap", "time")).where(taken)
    ends = laps_taken.groupBy("key", "lap").agg(F.max(F.struct("h", "doc_id", "size", "k")).alias("end"))
    return targets, ends.select("key", "lap", F.struct("end.h", "end.doc_id", "end.size").alias("last"), F.col("end.k").alias("n_last"))


def _near_ends(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The few rows whose doc_id is one of the ends'."""
    near = fresh_name("near", rows)
    ids = materialise(ends.select(F.col("last.doc_id").alias(near)).distinct(), "mix-near")  # at most a row per source and lap
    small = ids.count() * 16 <= 64 << 20
    return rows.join(F.broadcast(ids) if small else ids, rows["doc_id"].cast("long").eqNullSafe(ids[near]), "left_semi")


def _copies(rows: DataFrame, near: DataFrame, ends: DataFrame, names: tuple[str, str, str], copies: str, order: list[Column]) -> DataFrame:
    """``rows`` with how often each is taken: in place, from the ends of its source's laps.

    Only rows equal to an end, which are one document and among ``near``, are numbered, so that as many of them are
    taken as its lap holds.
    """
    key, size, h = names
    laps, place = fresh_name("laps", rows), fresh_name("place", rows)
    told = materialise(ends.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("last", "n_last")).alias(laps)), "mix-laps")  # a row per source
    told = F.broadcast(told) if told.count() * 400 <= 64 << 20 else told
    own = F.struct(F.col(h).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), F.col(size).alias("size"))
    at_end = F.coalesce(F.exists(laps, lambda e: own == e["last"]), F.lit(False)) & (F.col(size) > 0)
    # struct order has nulls first, as the queue has
    passed = F.when(F.col(size) > 0, F.coalesce(F.size(F.filter(laps, lambda e: own < e["last"])), F.lit(0))).otherwise(0)
    placed = rows.join(told, [key], "left").where(~at_end).withColumn(copies, passed)
    ended = near.join(told, [key], "left").where(at_end)
    ended = ended.withColumn(place, F.row_number().over(Window.partitionBy(h, "doc_id", key).orderBy(*order)))
    more = F.size(F.filter(laps, lambda e: (own == e["last"]) & (F.col(place) <= e["n_last"])))
    return placed.unionByName(ended.withColumn(copies, passed + more).drop(place)).drop(laps)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, laps: int = 2, seed: int = 6) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and are taken 0 words; a null source is a source of its own; repeated rows
    stand in the queue one after another; an empty table gives no rows. Reruns agree: the order hangs on hashes of
    doc_id and text alone.
    """
    names = ("key", "size", "h")
    rows = materialise(_sized(docs.select(as_long("doc_id"), F.col("source").cast("string").alias("source"), "text"), seed, names).drop("text"), "mix-sizes")
    targets, ends = queue(rows, weights, share, laps)
    placed = attach(rows, targets.select("key", "source_size", "target"), ["key"], "mix-shares", row_bytes=120)
    found = _copies(placed, _near_ends(placed, ends), ends, names, "copies", [F.lit(0)])
    return found.select("doc_id", "h", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _cut(queued: DataFrame):
    """(finish, rank) of the unit that reaches the budget, from a global range sort; None if nothing has a size.

    Finish times grow strictly within a source, so (finish, rank) names a unit. The sorted units are written with
    their partition's number; one row a partition tells where the budget is reached, and only there a running sum
    is taken.
    """
    budget = queued.agg(F.max("budget").alias("b")).first()["b"]
    if not budget:
        return None
    units = queued.select(F.explode("finish").alias("finish"), "rank", "size")
    ordered = units.repartitionByRange("finish", "rank").sortWithinPartitions("finish", "rank")
    ordered = materialise(ordered.withColumn("slot", F.spark_partition_id()), "mix-order")
    sums = ordered.groupBy("slot").agg(F.sum("size").alias("part"))
    running = sums.withColumn("before", F.coalesce(F.sum("part").over(Window.orderBy("slot").rowsBetween(_START, -1)), F.lit(0)))
    at = running.where((F.col("before") < budget) & (F.col("before") + F.col("part") >= budget)).orderBy("slot").first()
    if at is None:  # rounding of the budget at the very end
        return ordered.agg(F.max(F.struct("finish", "rank")).alias("u")).first()["u"]
    here = ordered.where(F.col("slot") == at["slot"])
    reached = F.sum("size").over(Window.partitionBy("slot").orderBy("finish", "rank").rowsBetween(_START, _NOW)) + at["before"]
    return here.withColumn("reached", reached).where(F.col("reached") >= budget).agg(F.min(F.struct("finish", "rank")).alias("u")).first()["u"]


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, laps: int = 2, seed: int = 6) -> DataFrame:
    """The mix itself: all columns of the documents taken, a row for each time one is taken.

    Texts are not shuffled: each row is dropped or repeated where it lies. Rows of one doc_id and text that differ in
    other columns are taken in the order of those.
    """
    names = tuple(fresh_name(x, docs) for x in ("key", "size", "h"))
    copies, sized = fresh_name("copies", docs), _sized(docs, seed, names)
    plain = sized.select(as_long("doc_id"), F.col("source").cast("string").alias("source"), *(F.col(c).alias(n) for c, n in zip(names, ("key", "size", "h"))))
    _, ends = queue(materialise(plain, "mix-sizes"), weights, share, laps)
    order = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text", "source")]
    found = _copies(sized, _sized(_near_ends(docs, ends), seed, names), ends, names, copies, order or [F.lit(0)])
    rows = found.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
