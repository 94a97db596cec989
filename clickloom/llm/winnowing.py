"""Benchmark decontamination by winnowing.

Words are hashed, every run of ``gram`` words gets a hash, and of each ``window - gram + 1`` neighbouring hashes the
least is kept, on both sides. A span of ``window`` words that a document shares with an item then always shares a kept
hash, so no such span is missed. A task extends each kept hash of its documents that may be one of the benchmark's to
the windows around it, and Spark joins these windows with the benchmark's by their words, which verifies them.

"May be" is asked of two bitmaps of bounded size, one of kept hashes and one of windows, that Spark's bitmap aggregates
fill: whatever the benchmark's size, it stays a table, and a fuller bitmap only lets more windows through to the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_long, attach, fresh_name, materialise, payloads, slices

#: Every byte that no word holds becomes a blank, A-Z become a-z. Bytes from 0x80 on are parts of letters.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(seeds: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
    """length -> hash of each run of so many words, from the words' hashes."""
    out, found = np.zeros(len(seeds), np.uint64), {}
    for j in range(min(max(lengths, default=0), len(seeds))):
        out = out[: len(seeds) - j] * _STEP + seeds[j:]
        if j + 1 in lengths:
            found[j + 1] = _mix(out ^ np.uint64(j + 1))
    return found


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the rightmost least hash in each run of ``width`` hashes (fewer: of all of them)."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    width = min(width, n)
    best = np.arange(n - width + 1)
    value = hashes[: n - width + 1].copy()
    for j in range(1, width):
        here = hashes[j : j + n - width + 1]
        less = here <= value
        best[less] = np.flatnonzero(less) + j
        value = np.minimum(value, here)
    return np.unique(best)


class WordHashes(dict):
    """word -> 64-bit hash, computed when first met; emptied when it grows large. Long words are not remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 64:
            self[word] = value
        return value

    def seeds(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_KEYS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("words", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("kept", T.LongType())])


def item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(item_id, words, size, run, kept) for every window of every item.

    ``run`` is the window's hash and ``kept`` the hash that winnowing keeps in it (an item shorter than ``window``
    words is one window and is found by ``run`` alone).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            for batch in slices(whole, most=1 << 20):
                rows: list[tuple] = []
                for item_id, data in zip(batch.column(0).to_pylist(), payloads(batch.column(1))):
                    words = words_of(data)
                    size = min(window, len(words))
                    if not size:
                        continue
                    hashes = run_hashes(memo.seeds(words), {size, gram})
                    runs = hashes[size].view(np.int64).tolist()
                    if size == window:
                        grams, width = hashes[gram], window - gram + 1
                        least = np.lib.stride_tricks.sliding_window_view(grams, width).min(1).view(np.int64).tolist()
                    else:
                        least = [None] * len(runs)
                    rows += [(item_id, b" ".join(words[p : p + size]).decode("utf-8", "replace"), size, r, k) for p, (r, k) in enumerate(zip(runs, least))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, _KEY_TYPES)], names=_KEYS.names)

    return benchmark.select(as_long("item_id"), "text").where("text is not null").mapInArrow(scan, _KEYS)


_KEY_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]


def bitmap(hashes: DataFrame, column: str, least: int = 1 << 15, most: int = 1 << 27) -> np.ndarray:
    """Bits (as bytes) of the low parts of a column of hashes: about 64 for each hash, ``most`` bits (16 MB) at most."""
    n = hashes.count()
    bits = least
    while bits < min(most, 64 * n):
        bits *= 2
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    cut = hashes.where(F.col(column).isNotNull()).select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("k"))
    out = np.zeros(bits // 8, np.uint8)
    # the aggregate's own offsets are used within a piece of 32,768 bits; rows: the bitmap's size / 4 KB
    for r in cut.agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("b")).toLocalIterator():
        out[4096 * r["k"] : 4096 * (r["k"] + 1)] = np.frombuffer(r["b"], np.uint8)
    return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Screen:
    """Finds the windows of documents that may be the benchmark's."""

    def __init__(self, kept: np.ndarray, runs: np.ndarray, short: set[int], window: int, gram: int) -> None:
        self.kept, self.runs, self.short, self.window, self.gram = kept, runs, short, window, gram
        self.lengths = short | {window, gram}

    def candidates(self, words: list[list[bytes]], memo: WordHashes) -> list[list[tuple[str, int, int]]]:
        """For each document the distinct windows with their word ranges [lo, hi), overlapping ones joined."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(counts)
        flat = [w for ws in words for w in ws]
        hashes = run_hashes(memo.seeds(flat), self.lengths)
        owner = np.repeat(np.arange(len(words)), counts)
        room = ends[owner] - np.arange(len(flat))  # words of its own document from each word on
        found: list[tuple[int, int]] = []
        if len(flat) >= self.window:
            # runs over a border are harmless: they only add kept hashes, and no window crosses a border
            at = winnow(hashes[self.gram], self.window - self.gram + 1)
            at = at[_has(self.kept, hashes[self.gram][at])]
            starts = np.unique((at[:, None] - np.arange(self.window - self.gram + 1)).ravel())
            starts = starts[(starts >= 0) & (starts < len(hashes[self.window]))]
            starts = starts[room[starts] >= self.window]
            starts = starts[_has(self.runs, hashes[self.window][starts])]
            found += [(p, self.window) for p in starts.tolist()]
        for size in self.short:
            if size in hashes:
                starts = np.flatnonzero(_has(self.runs, hashes[size]))
                found += [(p, size) for p in starts[room[starts] >= size].tolist()]
        out: list[dict[bytes, list[list[int]]]] = [{} for _ in words]
        for p, size in found:
            d = int(owner[p])
            lo = p - int(ends[d] - counts[d])
            ranges = out[d].setdefault(b" ".join(flat[p : p + size]), [])
            if ranges and lo <= ranges[-1][1]:
                ranges[-1][1] = lo + size
            else:
                ranges.append([lo, lo + size])
        return [[(w.decode("utf-8", "replace"), a, b) for w, ranges in d.items() for a, b in ranges] for d in out]


_CANDIDATE = T.StructType([T.StructField("words", T.StringType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
_ARROW_CANDIDATE = pa.list_(pa.struct([("words", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())]))
_TOLD = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("windows", T.ArrayType(_CANDIDATE))])
_ARROW_TOLD = pa.struct([("n_words", pa.int64()), ("windows", _ARROW_CANDIDATE)])


def _screened(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a column ``name`` (n_words, windows) from their texts, and the table of the benchmark's windows."""
    keys = materialise(item_windows(benchmark, window, gram), "benchmark-windows")
    short = {r["size"] for r in keys.where(F.col("size") < window).select("size").distinct().collect()}  # fewer than ``window`` rows
    screen = Screen(bitmap(keys.select("kept").distinct(), "kept"), bitmap(keys.select("run").distinct(), "run"), short, window, gram)
    shared = docs.sparkSession.sparkContext.broadcast(screen)

    @F.arrow_udf(_TOLD)
    def told(text: pa.Array) -> pa.Array:
        memo, out = WordHashes(), []
        for piece in slices(pa.RecordBatch.from_arrays([text], names=["text"]), text=0, most=1 << 20):
            words = [words_of(x) for x in payloads(piece.column(0))]
            found = shared.value.candidates(words, memo)
            out += [{"n_words": len(w), "windows": [{"words": x, "lo": a, "hi": b} for x, a, b in f]} for w, f in zip(words, found)]
        return pa.array(out, _ARROW_TOLD)

    return docs.withColumn(name, told.asNondeterministic()("text")), keys


def _hits(tagged: DataFrame, keys: DataFrame, row: str, name: str) -> DataFrame:
    """(row, words, lo, hi) of the windows that are the benchmark's, word by word.

    The distinct windows of the benchmark are broadcast while their counted size allows, else joined by shuffle; a
    window that many documents share then lies on the side that adaptive execution splits.
    """
    windows = tagged.where(F.size(f"{name}.windows") > 0).select(row, F.inline(f"{name}.windows"))
    known = keys.select("words").distinct().withColumn("known", F.lit(True))
    return attach(windows, known, ["words"], "benchmark-words", row_bytes=F.octet_length("words") + 40).where("known").drop("known")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """One row per document: doc_id, n_words, hit_spans (word ranges, end exclusive), item_ids.

    Null and wordless texts have no words and no hits. Repeated document rows each give a row. Items of the same id
    count once; an item with a null id marks words but has no id to list. Items without a word are left out; an item
    of fewer than ``window`` words is one window. Empty tables give empty results. Other columns are not read.

    A text of repeated words has few distinct windows, each with joined ranges, so its length does not multiply with
    that of an item.
    """
    told, keys = _screened(docs.select(as_long("doc_id"), "text"), benchmark, window, gram, "told")
    tagged = materialise(told.select("doc_id", "told").withColumn("row", F.monotonically_increasing_id()), "screened")
    hits = materialise(_hits(tagged, keys, "row", "told"), "benchmark-hits")
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.array("lo", "hi"))).alias("hit_spans"))
    listed = keys.where("item_id is not null").groupBy("words").agg(F.collect_set("item_id").alias("ids"))
    met = attach(hits.select("row", "words").distinct(), listed, ["words"], "benchmark-items", row_bytes=F.octet_length("words") + 8 * F.size("ids") + 60, how="inner")
    items = met.select("row", F.explode("ids").alias("id")).groupBy("row").agg(F.array_sort(F.collect_set("id")).alias("item_ids"))
    facts = spans.join(items, "row", "left")
    none = lambda t: F.array().cast(t)
    size = 48 * F.size("hit_spans") + 8 * F.coalesce(F.size("item_ids"), F.lit(0)) + 80
    found = attach(tagged.select("row", "doc_id", F.col("told.n_words").alias("n_words")), facts, ["row"], "benchmark-facts", row_bytes=size)
    return found.select("doc_id", "n_words", F.coalesce("hit_spans", none("array<array<bigint>>")).alias("hit_spans"), F.coalesce("item_ids", none("array<bigint>")).alias("item_ids"))


def contaminated_words(spans: str = "hit_spans"):
    """Number of distinct words that the sorted spans cover; they may overlap."""
    start, stop = (lambda s: F.element_at(s, 1)), (lambda s: F.element_at(s, 2))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), stop(s) - F.greatest(start(s), a["end"]))).alias("n"),
        F.greatest(a["end"], stop(s)).alias("end"),
    )
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of ``contamination``: n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark, **options)
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    n_hit = contaminated_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "hit_spans",
        "item_ids",
    )


def sha256_of_items(ids: list[int]) -> str:
    """The digest column, for brute-force comparisons."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """The documents (all columns, nulls included) that share no window with the benchmark.

    They are written once with their suspect windows, if any: those without one stay as they are, and only the others
    take part in a join. Repeated rows are judged alike; empty tables change nothing.
    """
    name, row = fresh_name("told", docs), fresh_name("row", docs)
    told, keys = _screened(docs, benchmark, window, gram, name)
    tagged = materialise(told.withColumn(row, F.monotonically_increasing_id()), "screened")
    bad = _hits(tagged, keys, row, name).select(row).distinct()
    suspects = attach(tagged.where(F.size(f"{name}.windows") > 0), bad.withColumn(fresh_name("bad", tagged), F.lit(True)), [row], "benchmark-rows", row_bytes=16)
    clean = suspects.where(F.col(fresh_name("bad", tagged)).isNull())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return tagged.where(F.size(f"{name}.windows") == 0).select(*columns).unionByName(clean.select(*columns))
