"""Periodic runs of words: every maximal repetition of each text, by a harmonic grid of suffix-array queries.

A run of period ``p`` and at least two periods' length covers two grid points ``j * p`` and ``(j + 1) * p``. So for each
``p`` up to half a text the longest common extensions of such pairs, forward from the words and backward from the words
before them, find every run. Extensions are range minima over the LCP arrays of the suffix array of the words and of that
of the reversed words. Texts of a batch share one pair of arrays; their suffixes never meet, as ranks start from
(text, word).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, payloads, ragged, slices

_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
#: Grid points that are compared at once.
_AT_ONCE = 1 << 21


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each suffix, LCP of each place with the one before), for texts laid end to end.

    ``ids`` are ranks by (text, word); ``ends`` the end of the text that each word is in. Prefix doubling: only suffixes
    that still share their rank are sorted again. The ranks by 2 ** k words give the LCP of neighbours.
    """
    n = len(ids)
    counts = np.bincount(ids)
    first = np.cumsum(counts) - counts
    rank = first[ids].astype(np.int32)
    levels, width, at = [rank], 1, np.flatnonzero(counts[ids] > 1)
    while len(at):
        then = at + width
        second = np.where(then < ends[at], rank[np.minimum(then, n - 1)] + 1, 0)
        key = (rank[at].astype(np.int64) << 32) | second
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.concatenate(([True], (key[1:] >> 32) != (key[:-1] >> 32)))
        place = np.arange(len(at))
        into = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        rank = rank.copy()
        rank[at] += into.astype(np.int32)
        levels.append(rank)
        width *= 2
        alone = new & np.concatenate((new[1:], [True]))
        at = np.sort(at[~alone])
    suffixes = np.empty(n, np.int32)
    suffixes[rank] = np.arange(n, dtype=np.int32)
    lcp = np.zeros(n, np.int32)
    pairs, top = np.arange(1, n), np.full(n, -1, np.int8)
    for k, level in enumerate(levels[:-1]):  # how far neighbours agree by doubling
        pairs = pairs[level[suffixes[pairs - 1]] == level[suffixes[pairs]]]
        top[pairs] = k
        lcp[pairs] = 1 << k
    for k in range(len(levels) - 2, -1, -1):  # and by what more
        pairs = np.flatnonzero(top > k)
        a, b = suffixes[pairs - 1] + lcp[pairs], suffixes[pairs] + lcp[pairs]
        inside = (a < ends[suffixes[pairs - 1]]) & (b < ends[suffixes[pairs]])
        pairs, a, b = pairs[inside], a[inside], b[inside]
        lcp[pairs[levels[k][a] == levels[k][b]]] += 1 << k
    return rank, lcp


class Extensions:
    """Longest common extensions of pairs of words of one text: range minima over the LCP array."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, longest: int) -> None:
        self.rank, lcp = suffix_array(ids, ends)
        self.table, width = [lcp], 1
        while 2 * width <= longest:  # places of one text lie within its length
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]) if width < len(last) else last)
            width *= 2

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self.rank[x], self.rank[y]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(x), np.int32)
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            row = self.table[k]
            out[of] = np.minimum(row[lo[of]], row[hi[of] - (1 << k)])
        return out


def maximal_runs(words: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
    """Rows (text, start, length, period) of every run of ``least`` words or more, by text, start and period.

    ``words`` are numbers of words of the texts laid end to end, equal for equal words.
    """
    n = len(words)
    starts = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.repeat(starts + lengths, lengths)
    none = np.empty((0, 4), np.int64)
    if n < least:
        return none
    # every (text, period) with its grid points
    halves = np.where(lengths >= least, lengths // 2, 0)
    owner = np.repeat(np.arange(len(lengths)), halves)
    period = ragged(np.ones(len(lengths), np.int64), halves)
    points = (lengths[owner] - 1) // np.maximum(period, 1)
    upto = np.cumsum(points)
    pairs = []
    at = 0
    while at < len(points):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _AT_ONCE, "right")))
        p = np.repeat(period[at:stop], points[at:stop])
        x = np.repeat(starts[owner[at:stop]], points[at:stop]) + ragged(np.zeros(stop - at, np.int64), points[at:stop]) * p
        same = np.flatnonzero(words[x] == words[x + p])
        pairs.append((x[same].astype(np.int32), p[same].astype(np.int32)))
        at = stop
    x, p = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.empty(0, np.int32),) * 2
    if not len(x):
        return none
    ids = np.unique(text.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True)[1].astype(np.int32)
    longest = int(lengths.max())
    ahead = Extensions(ids, ends, longest).of(x, x + p)
    mirror = (np.repeat(2 * starts + lengths - 1, lengths) - np.arange(n)).astype(np.int32)
    inside = np.flatnonzero(x > starts[text[x]])  # a text's first word has none before it
    behind = np.zeros(len(x), np.int32)
    behind[inside] = Extensions(ids[mirror], ends, longest).of(mirror[x[inside] - 1], mirror[x[inside] + p[inside] - 1])
    total = p + ahead + behind
    good = np.flatnonzero(total >= np.maximum(least, 2 * p))
    start, length, p = (x - behind)[good].astype(np.int64), total[good].astype(np.int64), p[good].astype(np.int64)
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    # one stretch is met at its least period and at multiples of it; the least is the run's
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    rows = np.stack((text[start], start - starts[text[start]], length, p), axis=1)[first]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _numbered(words: list[bytes]) -> np.ndarray:
    return pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def periodic_runs(docs: DataFrame, least: int = 12, rewrite: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. In the collapsed text every run keeps its first period only, and
    words are joined by one space. ``rewrite`` tells, for a doc_id and a number of words, which word stands at each place
    instead (None: as they are); a row without doc_id is never rewritten. Null, empty and blank texts have no words and no
    runs; repeated rows keep a row each; an empty table gives none. Other columns are not read.

    A text is one piece of work, in memory about 100 bytes a word for each doubling that its longest repeat needs; nothing
    is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=4 << 20):
                ids = batch.column(0).to_pylist()
                texts = [x.split() for x in payloads(batch.column(1))]
                words = [w for t in texts for w in t]
                lengths = np.fromiter(map(len, texts), np.int64, len(texts))
                starts = np.cumsum(lengths) - lengths
                number, source = _numbered(words), np.arange(len(words))
                changed = np.zeros(len(texts), bool)
                for k, doc in enumerate(ids):
                    new = rewrite(doc, int(lengths[k])) if rewrite and doc is not None and lengths[k] else None
                    if new is not None:
                        source[starts[k] : starts[k] + lengths[k]] = starts[k] + new
                        changed[k] = True
                found = maximal_runs(number[source], lengths, least)
                turn = np.zeros(len(words) + 1, np.int32)
                begin = starts[found[:, 0]] + found[:, 1]
                np.add.at(turn, begin + found[:, 3], 1)
                np.add.at(turn, begin + found[:, 2], -1)
                dropped = np.cumsum(turn[:-1]) > 0
                changed[found[:, 0]] = True
                cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
                collapsed = []
                for k, t in enumerate(texts):
                    if changed[k]:
                        of = slice(starts[k], starts[k] + lengths[k])
                        t = [words[i] for i in source[of][~dropped[of]].tolist()]
                    collapsed.append(b" ".join(t))
                run = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in (1, 2, 3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(pa.array(cuts), run), pa.array(collapsed, pa.binary())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(as_long("doc_id"), "text").mapInArrow(scan, _FOUND).withColumn("collapsed", F.col("collapsed").cast("string"))


def longest_run(runs: str = "runs"):
    """The run of greatest length, then smallest start, then smallest period; null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    return F.when(best.isNotNull(), F.struct((-best["back"]).alias("start"), best["length"].alias("length"), (-best["less"]).alias("period")))
