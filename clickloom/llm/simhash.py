"""SimHash near-duplicates: exact tiled comparison of fingerprints with exclusive-or and bit counts.

Cut into ``radius + k`` blocks, fingerprints within ``radius`` bits of each other agree on all bits of some ``k``
blocks, so tiles only meet inside the groups of one such key; the larger the table, the longer its keys. Within a group the fingerprints are sorted by population count, cut
into tiles, and tile pairs whose population counts differ by more than the radius are skipped. No link is lost,
and no pairs but a spanning forest leave a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_long, materialise, payloads, slices
from .components import components

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_FINGERPRINT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprint(data: bytes, width: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of a text's bytes: bit set where more than half the shingle hashes have it; no word: 0."""
    words = data.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[width - 1 :]
    starts = np.concatenate(([0], ends[:-width] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist())]
    n = len(hashes)
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = bits.sum(0, dtype=np.int64) * 2 > n
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp as signed long) of every whole text. Null and wordless texts have fingerprint 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                prints = np.fromiter((fingerprint(x, width, seed) for x in payloads(batch.column(1))), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(as_long("doc_id"), "text").mapInArrow(scan, _FINGERPRINT)


class _Forest:
    """Union-find over rows of one group; keeps what a spanning forest needs."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def tile_links(prints: np.ndarray, sides: np.ndarray, radius: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the fingerprints within ``radius`` bits, as index pairs.

    ``sides``: 0 for all against all; in a cell of two sides, 1 and 2, only rows of different sides are compared.
    """
    count = np.bitwise_count(prints)
    order = np.argsort(count, kind="stable")
    p, c, s = prints[order], count[order].astype(np.int16), sides[order]
    forest = _Forest(len(p))
    cuts = list(range(0, len(p), tile))
    for i, a in enumerate(cuts):
        top = c[min(a + tile, len(p)) - 1]
        for b in cuts[i:]:
            if c[b] - top > radius:
                break  # sorted by population count: all later tiles are farther still
            x, y = p[a : a + tile], p[b : b + tile]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            left, right = np.nonzero(near)
            keep = (left + a < right + b) & ((s[left + a] != s[right + b]) | (s[left + a] == 0))
            left, right = left[keep] + a, right[keep] + b
            if len(left) > 64:  # many links: those to what is linked already add nothing
                fresh = np.fromiter((forest.root(k) for k in range(len(p))), np.int64, len(p))
                keep = fresh[left] != fresh[right]
                left, right = left[keep], right[keep]
            forest.link(left, right)
    tops = np.fromiter((forest.root(k) for k in range(len(p))), np.int64, len(p))
    child = np.flatnonzero(tops != np.arange(len(p)))
    return order[child], order[tops[child]]


def _linker(radius: int, tile: int):
    """Compare group by group over rows sorted by (band, key, cell); groups may span Arrow batches."""

    def work(prints: np.ndarray, ids: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = tile_links(prints, sides, radius, tile)
        return ids[a], ids[b]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        held_key = None

        def flush() -> tuple[np.ndarray, np.ndarray]:
            prints, ids, sides = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return work(prints.view(np.uint64), ids, sides)

        for batch in batches:
            if not batch.num_rows:
                continue
            group, side, prints, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
            left, right = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if held and group[a] != held_key:
                    x, y = flush()
                    left.append(x)
                    right.append(y)
                held_key = group[a]
                held.append([prints[a:b].copy(), ids[a:b].copy(), side[a:b].copy()])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["u", "v"])
        if held:
            x, y = flush()
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["u", "v"])

    return scan


def key_plan(n_rows: int, radius: int, group_rows: int, most_agree: int = 4) -> list[list[tuple[int, int]]]:
    """The keys that make groups, each as (first bit, bits) pieces.

    A table of ``group_rows`` rows or fewer is one group. Beyond that ``k`` blocks must agree, as few as give groups of
    about ``group_rows`` random rows: more blocks make more and longer keys, so work stays in proportion to the rows.
    """
    if n_rows <= group_rows:
        return [[(0, 0)]]
    for agree in range(1, most_agree + 1):
        blocks = radius + agree
        edges = [64 * i // blocks for i in range(blocks + 1)]
        pieces = [(a, b - a) for a, b in zip(edges, edges[1:])]
        keys = [list(x) for x in itertools.combinations(pieces, agree)]
        if n_rows <= group_rows << min(sum(b for _, b in k) for k in keys):
            break
    return keys


def links(reps: DataFrame, n_rows: int, radius: int = 4, tile: int = 256, group_rows: int = 1024, most_rows: int = 8192) -> DataFrame:
    """Edges (u, v) between the ids of distinct fingerprints ``reps(fp, id)`` within ``radius`` bits.

    Rows are grouped by each key of ``key_plan``. Groups above ``most_rows`` are cut by a hash into parts, and every
    pair of parts is a cell of its own, so that no task holds more than a cell of bounded size.
    """
    bands = []
    for i, pieces in enumerate(key_plan(n_rows, radius, group_rows)):
        parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b) - 1)) for a, b in pieces]
        bands.append(F.xxhash64(F.lit(i), *parts).alias(f"g{i}"))  # keys that share a hash only meet more rows
    banded = reps.select("fp", "id", F.explode(F.array(*bands)).alias("grp"))
    hot = banded.groupBy("grp").count().where(F.col("count") > most_rows)
    parts = F.ceil(F.col("count") / F.lit(most_rows // 2)).cast("int")
    marked = banded.join(hot.select("grp", parts.alias("parts")), "grp", "left")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    cold = marked.where("parts is null").select("grp", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "fp", "id")
    cells = (
        marked.where("parts is not null")
        .select("grp", "fp", "id", "parts", part.alias("own"))
        .select("grp", "fp", "id", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select(
            "grp",
            F.least("own", "other").alias("a"),
            F.greatest("own", "other").alias("b"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
            "fp",
            "id",
        )
    )
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    return (
        cold.unionByName(cells)
        .withColumn("cell", F.xxhash64("grp", "a", "b"))
        .repartition("grp", "a", "b")
        .sortWithinPartitions("cell")
        .select("cell", "side", "fp", "id")
        .mapInArrow(_linker(radius, tile), schema)
    )


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """One row per document row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null, empty and wordless texts share fingerprint 0 and are linked like any other. Repeated rows keep a row each.
    A null doc_id takes part in no minimum but keeps its row. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, width, seed), "simhash")
    reps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"), "simhash-reps")
    found = components(links(reps, reps.count(), radius))
    known = reps.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(known, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents (all columns) whose doc_id is their component's; of repeated rows of that id the least stays.

    Rows without a doc_id cannot be named as anyone's copy and stay.
    """
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    chosen = near_duplicates(named, **options).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    chosen = materialise(chosen, "simhash-chosen")
    columns, same = [F.col(f"`{c}`") for c in docs.columns], lambda ids: named["doc_id"].cast("long") == ids["doc_id"]
    once, often = chosen.where("n = 1"), chosen.where("n > 1")
    # what stays grows with the documents: never broadcast
    kept = named.join(once.hint("merge"), same(once), "left_semi").unionByName(nameless)
    if often.isEmpty():
        return kept
    # rows of one id in the order of all their columns as text: the same one stays whatever the partitions
    order = F.struct(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in docs.columns))
    least = named.join(often.hint("merge"), same(often), "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("row"))
    return kept.unionByName(least.select("row.*"))
