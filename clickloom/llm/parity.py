"""N-gram Jaccard join by parity sketches.

A set's sketch has a bit for each value of a hash; a shingle turns one bit over. Two sketches differ in at most as many
bits as the sets differ in shingles, so their Hamming distance bounds the symmetric difference from below, and half a
sketch is the exclusive-or of both halves of the longer one. Sets of at most ``r`` shingles that link differ in at most
``D`` of them, so of more than ``D`` blocks of bits at least one has equal bits in both: the join meets sets of a size
band in the blocks' values. Bits of a block are told by the exclusive-or of the hashes of its shingles.

Pairs that meet are cut down by whole sketches and verified on the sets. Each group of equal blocks is tested in three
rounds: all against one member that is the same in all groups of the band, then what is in no component with the rest
against a member of the group's own, then all pairs of what is still in different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, attach, materialise, payloads, ragged, slices
from .components import components

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_U = np.uint64


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Every bit of the result hangs on every bit of ``x``."""
    x = (x ^ _U(salt)) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(29))


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct shingles of each text, sorted and laid end to end; how many each has).

    Texts of fewer than ``width`` words have the whole sequence as one shingle, those without words none.
    """
    words = [t.translate(_LOWER).split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    if not n.sum():
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    told = pa.array([w for t in words for w in t], pa.large_binary()).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh64_intdigest, told.dictionary.to_pylist()), np.uint64, len(told.dictionary))
    h = known[told.indices.to_numpy(zero_copy_only=False)]
    starts, take = np.cumsum(n) - n, np.where(n < width, np.minimum(n, 1), n - width + 1)
    at = ragged(starts, take)
    owner = np.repeat(np.arange(len(n)), take)
    size = np.minimum(n, width)[owner]
    total = size.astype(np.uint64)
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64), 0x77) | _U(1)  # odd, and without a pattern among them
    for k in range(width):
        inside = np.flatnonzero(size > k)
        total[inside] += h[at[inside] + k] * factors[k]
    total = mixed(total)
    ends = np.cumsum(take)
    for a, b in zip((ends - take).tolist(), ends.tolist()):
        total[a:b].sort()
    new = np.concatenate(([True], (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])))
    return total[new], np.bincount(owner[new], minlength=len(n))


def sketch_bits(size: int) -> int:
    """Bits of a set's sketch: the power of two from twice its size on, at least 64.

    Few enough shingles share a bit that sets a seventh farther apart than linked ones may be are told apart.
    """
    return max(64, 1 << (2 * max(size, 1) - 1).bit_length())


def sketch(hashes: np.ndarray) -> bytes:
    bits = sketch_bits(len(hashes))
    odd = np.bincount((mixed(hashes, 0x51) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, length: int) -> np.ndarray:
    """A sketch's bytes at a shorter length: halves are added up by exclusive-or until it has it."""
    while len(x) > length:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def differ(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    length = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, length) ^ folded(y, length)).sum())


def most_differing(a: int, b: int, share: Fraction) -> int:
    """The largest symmetric difference of sets of these sizes whose intersection is ``share`` of the union or more."""
    return int((a + b) * (1 - share) / (1 + share))


def bands(largest: int, share: Fraction) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, D, blocks) of each band.

    A pair belongs to the band of its larger set; the band reaches down to the smallest set that may link to one there.
    There are some more blocks than D, so that nearly every set has more than D blocks with a shingle. Bands twice as
    wide as sizes that link give the fewest blocks, as a set is in one and a half of them on average.
    """
    out, below = [], 0
    while below < largest:
        upto = max(below + 1, int(below / share / share))
        most = most_differing(upto, upto, share)
        blocks = 1 if not most else int(most * 1.22) + 3
        out.append((-int(-(below + 1) * share // 1), upto, most, blocks))
        below = upto
    return out


def block_keys(hashes: np.ndarray, counts: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of every block of every band that each set is in.

    Blocks without a shingle are left out where a set has more than D with one: of two linked sets such a one agrees with
    the other on a block that is not empty. Sets with fewer give all their blocks.
    """
    plan = [x for x in bands(int(counts.max(initial=0)), share) if x[2]]  # below, only equal sets link
    low, high, most, blocks = (np.array(c, np.int64) for c in zip(*plan)) if plan else (np.empty(0, np.int64),) * 4
    band, of = np.nonzero((counts[None, :] >= low[:, None]) & (counts[None, :] <= high[:, None]))
    starts = np.cumsum(counts) - counts
    cells = blocks[band]
    offset = np.cumsum(cells) - cells
    total = np.zeros(int(cells.sum()), np.uint64)
    filled = np.zeros(len(total), bool)
    at = 0
    sizes = np.cumsum(counts[of])
    while at < len(band):  # some millions of shingles at a time
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 19), "right")))
        n = counts[of[at:stop]]
        h = hashes[ragged(starts[of[at:stop]], n)]
        cell = np.repeat(offset[at:stop], n) + (mixed(h, 0xB1) % np.repeat(cells[at:stop], n).astype(np.uint64)).astype(np.int64)
        np.bitwise_xor.at(total, cell, mixed(h, 0xC3))
        filled[cell] = True
        at = stop
    row = np.repeat(np.arange(len(band)), cells)
    has = np.bincount(row[filled], minlength=len(band))
    give = filled | (has <= most[band])[row]
    block = np.arange(len(total)) - offset[row]
    key = mixed(total + mixed((band[row].astype(np.uint64) << _U(32)) + block.astype(np.uint64), 0xD7))
    return of[row[give]], key[give]


_FACTS = "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"
_SETS = "id long, n int, hashes binary"
_KEYS = "key long, id long, n int"


def set_facts(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, two 64-bit hashes of the set, its sketch) of every whole text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=2 << 20):
                hashes, counts = shingle_sets(payloads(batch.column(1)), width)
                ends = np.cumsum(counts)
                sums = []
                for salt in (0x11, 0x22):
                    upto = np.concatenate(([_U(0)], np.cumsum(mixed(hashes, salt), dtype=np.uint64)))
                    sums.append(pa.array(mixed(upto[ends] - upto[ends - counts]).view(np.int64)))
                told = [sketch(hashes[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *sums, pa.array(told, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.select(as_long("doc_id"), "text").mapInArrow(scan, _FACTS)


def _members(share: Fraction, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=2 << 20):
                hashes, counts = shingle_sets(payloads(batch.column(1)), width)
                of, key = block_keys(hashes, counts, share)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for a in range(0, len(of), 1 << 19):
                    part = of[a : a + (1 << 19)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 19)].view(np.int64)), pa.array(ids[part]), pa.array(counts[part].astype(np.int32))], names=["key", "id", "n"])

    return scan


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of keys that two sets or more have, with the key's first member as hub; rows come in order, none is kept."""
    held: tuple | None = None  # the first row of the open key, and whether it has been told
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.concatenate(([held is None or key[0] != held[0]], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        hub = np.where(first >= 0, ids[first], held[1] if held else 0)
        last = np.concatenate((new[1:], [True]))
        keep = ~(new & last)  # the last row may stay alone or not; see below
        out = [key[keep], ids[keep], n[keep], hub[keep]]
        if held and not held[3] and not new[0]:  # the row held back has company
            out = [np.concatenate(([a], b)) for a, b in zip((held[0], held[1], held[2], held[1]), out)]
        alone = bool(new[-1])  # held back until the next batch tells
        held = (key[-1], ids[-1], n[-1], False) if alone else (key[-1], hub[-1], 0, True)
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[2].astype(np.int32)), pa.array(out[3].astype(np.int64))], names=["key", "id", "n", "hub"])


def _near(share: Fraction):
    """Pairs (u, v, and their sizes and sketches) whose sketches allow a link."""
    p, q = share.numerator, share.denominator

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            most = ((a.astype(np.int64) + b) * (q - p)) // (q + p)
            keep = np.fromiter((differ(s, t) <= m for s, t, m in zip(x, y, most.tolist())), bool, len(x))
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return scan


def _linked(share: Fraction):
    """Pairs whose sets link, by counting their common shingles."""
    p, q = share.numerator, share.denominator

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text=2):
                x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                keep = []
                for s, t in zip(x, y):
                    a, b = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                    both = np.concatenate((a, b))
                    both.sort(kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    keep.append(q * same >= p * (len(a) + len(b) - same))
                keep = np.array(keep, bool)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["u", "v"])

    return scan


_PAIR = "u long, v long"


class _Verifier:
    """Verifies pairs of ids against the texts of the documents that stand for their sets."""

    def __init__(self, docs: DataFrame, reps: DataFrame, share: Fraction, width: int) -> None:
        self.docs, self.reps, self.share, self.width = docs, reps, share, width

    def links(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (u, v) that link; repeated ones are verified once."""
        side = lambda c, n, s: self.reps.select(F.col("id").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
        told = pairs.join(side("u", "a", "x"), "u").join(side("v", "b", "y"), "v").select("u", "v", "a", "b", "x", "y")
        near = materialise(told.mapInArrow(_near(self.share), _PAIR), f"{label}-near")
        wanted = near.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        texts = attach(self.docs, wanted, ["id"], f"{label}-ids", 16, how="left_semi")
        width = self.width

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, most=2 << 20):
                    hashes, counts = shingle_sets(payloads(batch.column(1)), width)
                    ends = np.cumsum(counts)
                    told = [hashes[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int32)), pa.array(told, pa.binary())], names=["id", "n", "hashes"])

        kept = materialise(texts.mapInArrow(sets, _SETS), f"{label}-sets")
        with_u = near.join(kept.select(F.col("id").alias("u"), F.col("hashes").alias("x")), "u")
        both = with_u.join(kept.select(F.col("id").alias("v"), F.col("hashes").alias("y")), "v").select("u", "v", "x", "y")
        return materialise(both.mapInArrow(_linked(self.share), _PAIR).distinct(), f"{label}-links")


def _cross_pairs(share: Fraction, tile: int = 128, small: int = 64):
    """Pairs of one cell in different components whose sizes and sketches allow a link; cells come one after another.

    Rows are (cell, side, id, n, component, sketch); sides as in ``in_cells``. Cells of at most ``small`` rows are met
    together, a pair of several of them once; larger ones in tiles, one cell at a time.
    """
    p, q = share.numerator, share.denominator

    def near(rows: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of places (i, j) those in different components and sides that may link."""
        side, ids, n, comp, told = rows
        low, high = np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
        ok = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (q * low >= p * high)
        i, j, most = i[ok], j[ok], ((low + high) * (q - p) // (q + p))[ok]
        if len(i):  # a pair of several cells is told once
            both = np.stack((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
            first = np.unique(both, axis=1, return_index=True)[1]
            i, j, most = i[first], j[first], most[first]
        size = np.fromiter(map(len, told), np.int64, len(told))
        length, keep = np.minimum(size[i], size[j]), np.zeros(len(i), bool)
        for k in np.unique(length).tolist():
            of = np.flatnonzero(length == k)
            used, at = np.unique(np.concatenate((i[of], j[of])), return_inverse=True)
            bits = np.stack([folded(np.frombuffer(told[x], np.uint8), k) for x in used.tolist()]).view(np.uint64)
            for a in range(0, len(of), 1 << 14):
                x, y = at[: len(of)][a : a + (1 << 14)], at[len(of) :][a : a + (1 << 14)]
                part = of[a : a + (1 << 14)]
                keep[part] = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= most[part]
        return i[keep], j[keep]

    def of_small(rows: tuple, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        behind = np.repeat(np.cumsum(counts), counts) - np.arange(len(rows[1])) - 1
        i = np.repeat(np.arange(len(behind)), behind)
        j = ragged(np.arange(len(behind)) + 1, behind)
        return near(rows, i, j)

    def of_large(rows: tuple) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows[2], kind="stable")
        n, left, right = rows[2][order].astype(np.int64), [order[:0]], [order[:0]]
        for a in range(0, len(order), tile):
            for b in range(a, len(order), tile):
                if q * n[min(a + tile, len(n)) - 1] < p * n[b]:
                    break  # sorted by size: all later ones are too large
                x, y = (c.ravel() for c in np.meshgrid(order[a : a + tile], order[b : b + tile], indexing="ij"))
                if a == b:
                    x, y = x[x < y], y[x < y]
                x, y = near(rows, x, y)
                left.append(x)
                right.append(y)
        return np.concatenate(left), np.concatenate(right)

    def found(rows: tuple, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        few = np.repeat(counts <= small, counts)
        parts = [(tuple(x[few] for x in rows), counts[counts <= small])]
        ends = np.cumsum(counts)
        parts += [(tuple(x[ends[k] - counts[k] : ends[k]] for x in rows), None) for k in np.flatnonzero(counts > small)]
        for part, sizes in parts:
            i, j = of_large(part) if sizes is None else of_small(part, sizes)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(part[1][i]), pa.array(part[1][j])], names=["u", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the cell that the last batch left open
        open_cell = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, *columns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            told = np.empty(batch.num_rows, object)
            told[:] = batch.column(5).to_pylist()
            columns = [*(c.copy() for c in columns), told]
            edges = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
            start = 0
            if held and cell[0] == open_cell:
                start = 1
                held.append(tuple(c[: edges[1]] for c in columns))
            if held and len(edges) > start + 1:  # the open cell has ended
                rows = tuple(np.concatenate(x) for x in zip(*held))
                yield from found(rows, np.array([len(rows[0])]))
                held = []
            if len(edges) > start + 1:
                a, b = edges[start], edges[-2]
                if b > a:
                    yield from found(tuple(c[a:b] for c in columns), np.diff(edges[start:-1]))
                held = [tuple(c[b:] for c in columns)]
            open_cell = cell[-1]
        if held:
            rows = tuple(np.concatenate(x) for x in zip(*held))
            yield from found(rows, np.array([len(rows[0])]))

    return scan


def in_cells(rows: DataFrame, key: str, most_rows: int) -> DataFrame:
    """``rows`` with (cell, side): a group of equal ``key`` is a cell of side 0; above ``most_rows`` it is cut by a hash of
    ``id`` into parts, and every pair of parts is a cell, whose sides 1 and 2 are to be compared with each other only.
    """
    hot = rows.groupBy(key).count().where(F.col("count") > most_rows).select(key, F.ceil(F.col("count") / F.lit(most_rows // 2)).cast("int").alias("parts"))
    marked = rows.join(hot, key, "left")
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")
    others = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    cut = marked.withColumn("own", F.coalesce(own, F.lit(-1))).withColumn("other", F.explode(others)).drop("parts")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return cut.withColumn("cell", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", side).drop("own", "other")


def _sketch_at_most(most: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [folded(np.frombuffer(s, np.uint8), most).tobytes() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(short, pa.binary())], names=["id", "n", "sketch"])

    return scan


def _each_text_once(docs: DataFrame, again: DataFrame) -> DataFrame:
    """(id, text) with each text of a doc_id once; only those of the ids ``again`` are exchanged."""
    docs = docs.withColumnRenamed("doc_id", "id")
    if again.isEmpty():
        return docs
    ids = again.withColumnRenamed("doc_id", "id")
    texts = docs.join(ids, "id", "left_semi").groupBy("id", F.sha2("text", 256).alias("same")).agg(F.first("text").alias("text")).select("id", "text")
    return docs.join(ids, "id", "left_anti").unionByName(materialise(texts, "parity-texts"))


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5, most_rows: int = 4096) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Sets are the distinct ``width``-word shingles of whole texts, A-Z lower-cased, told by 64-bit hashes; sets whose
    intersection is ``percent`` of the union or more link. Equal sets are one class and are joined once. Null, empty and
    blank texts have no shingle and link to nothing. Repeated rows keep a row each; rows of one doc_id are one node,
    whatever their texts. A row without doc_id takes part in no minimum and makes no link of its own; its component_id is
    that of its equals, or null. An empty table gives none; other columns are not read.

    No task holds more than a cell of ``most_rows`` rows of a group; groups stream through the first two rounds.
    """
    share = Fraction(percent, 100)
    facts = materialise(set_facts(docs, width), "parity-facts")
    named = facts.where("doc_id is not null")
    again = materialise(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "parity-again")
    docs = _each_text_once(docs.where("doc_id is not null").select(as_long("doc_id"), "text"), again)
    reps = named.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"))
    reps = materialise(reps.select("id", F.col("n_shingles").cast("int").alias("n"), "h1", "h2", "sketch"), "parity-sets")
    texts = attach(docs, reps.select("id").distinct(), ["id"], "parity-ids", 16, how="left_semi")
    keys = texts.mapInArrow(_members(share, width), _KEYS)
    # one order of members in all groups: near copies of one text have one hub, so a pair is verified once
    met = keys.repartition("key").sortWithinPartitions("key", F.xxhash64("id"), "id").mapInArrow(_met, "key long, id long, n int, hub long")
    met = materialise(met, "parity-met")
    verifier = _Verifier(docs, reps, share, width)

    classes = reps.select(F.col("n").cast("long").alias("n_shingles"), "h1", "h2", F.col("id").alias("u"))
    one_node = named.join(again, "doc_id", "left_semi").join(classes, ["n_shingles", "h1", "h2"]).select("u", F.col("doc_id").alias("v"))
    found = components(one_node.unionByName(verifier.links(met.select(F.col("hub").alias("u"), F.col("id").alias("v")), "parity-1")))
    open_ = met.select("key", "id", "n")
    for last in (False, True):
        rows = open_.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed_ = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("id", "component"), F.xxhash64("id", "key")).alias("hub")).where("lo <> hi")
        rows = materialise(rows.join(mixed_.select("key", "hub"), "key"), "parity-open")
        open_ = rows.select("key", "id", "n")
        if not last:
            pairs = rows.where("component <> hub.component").select(F.col("hub.id").alias("u"), F.col("id").alias("v"))
        else:
            cells = in_cells(rows.select("key", "id", "n", "component"), "key", most_rows)
            short = reps.select("id", "n", "sketch").mapInArrow(_sketch_at_most(512), "id long, n int, sketch binary")
            told = cells.join(short.select("id", "sketch"), "id").select("cell", "side", "id", "n", "component", "sketch")
            pairs = told.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cross_pairs(share), _PAIR)
        links = verifier.links(pairs, f"parity-{3 if last else 2}")
        found = components(links.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    known = found.withColumnRenamed("node", "id")
    whole = reps.join(known, "id", "left").select("n", "h1", "h2", F.coalesce("component", "id").alias("component_id"))
    whole = whole.groupBy("n", "h1", "h2").agg(F.min("component_id").alias("component_id"))
    out = facts.join(whole, (facts["n_shingles"] == whole["n"]) & (facts["h1"] == whole["h1"]) & (facts["h2"] == whole["h2"]), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
