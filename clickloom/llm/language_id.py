"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language parses a text into phrases, each the longest match that the
automaton holds. The language that needs the fewest phrases for the text, weighed by the bits that name a place in
its labelled text, wins. In a task, the transitions of all automata lie in one sparse table, so that neither the
number of letters nor the number of languages is bounded by its width; many pieces of texts take their steps together,
and a piece is parsed again from the state that the piece before it ends in until both parses agree, so phrases are
those of one parse of the whole text.
"""

from __future__ import annotations

import pickle
import random
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_long, attach, crc_bucket, fresh_name, materialise, slices

UNKNOWN = "und"
#: Symbols: 0 fills pieces up, 1 is anything but a letter or its mark, 2 a letter that no labelled text has.
_FILL, _GAP, _OTHER, _FIRST = 0, 1, 2, 3
_POINTS = 0x110000
_LOW = (1 << 32) - 1


def _folded(point: int) -> str:
    return chr(point).lower()[0]


def letter_table(letters: str) -> np.ndarray:
    """code point -> symbol, whatever the case; marks count as letters here, so that words of any script hold together."""
    symbol = {c: _FIRST + k for k, c in enumerate(letters)}
    out = np.full(_POINTS, _GAP, np.int32)
    for p in range(_POINTS):
        c = chr(p)
        if c.isalpha() or (p > 0x2FF and unicodedata.category(c)[0] == "M"):
            out[p] = symbol.get(_folded(p), _OTHER)
    return out


def is_letter() -> np.ndarray:
    return np.fromiter((chr(p).isalpha() for p in range(_POINTS)), bool, _POINTS)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str | np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of a text, runs of other characters as one gap."""
    codes = table[points(text) if isinstance(text, str) else text]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _GAP) | (codes[:-1] != _GAP)
    return codes[keep]


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions by state, from state 0, of all substrings."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        here = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = here
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return follow


class SparseTable:
    """Transitions of several automata in one array: the step of the state at place ``b`` for symbol ``s`` is at ``b + s``.

    Rows overlap where they leave gaps; an entry holds its owner's place, which tells whether it is the state's own.
    """

    def __init__(self) -> None:
        self.size, self.steps = 0, []

    def add(self, follow: list[dict[int, int]], width: int) -> int:
        """Place an automaton, the fullest rows first, in a part of its own; the place of its root.

        The part is three times as long as it has entries, so a place drawn at random soon fits.
        """
        rng, at = random.Random(len(follow)), [0] * len(follow)
        room = 3 * sum(map(len, follow)) + len(follow) + 64
        taken, places = bytearray(room + width), set()
        for i in sorted(range(len(follow)), key=lambda i: (-len(follow[i]), i)):
            row = list(follow[i])
            while True:
                b = rng.randrange(room)
                if b not in places and not any(taken[b + s] for s in row):
                    break
            places.add(b)
            for s in row:
                taken[b + s] = 1
            at[i] = self.size + b
        self.size += len(taken)
        self.steps += [(at[i], s, at[j]) for i, row in enumerate(follow) for s, j in row.items()]
        return at[0]

    def cells(self, width: int) -> np.ndarray:
        out = np.full(self.size + width, -1, np.int64)
        owner, symbol, to = (np.array(x, np.int64) for x in zip(*self.steps)) if self.steps else [np.empty(0, np.int64)] * 3
        out[owner + symbol] = owner << 32 | to
        return out


@dataclass
class Parser:
    """All languages' automata. A letter that the labelled text lacks is a phrase of its own, after the one before it."""

    languages: list[str]
    letters: np.ndarray  # code point -> symbol
    alphabetic: np.ndarray
    cells: np.ndarray
    roots: np.ndarray
    anew: np.ndarray  # (language, symbol): state after a symbol that begins a phrase
    lacks: np.ndarray  # (language, symbol): 1 where the labelled text has no such symbol
    bits: np.ndarray  # that name a place in each language's labelled text

    @classmethod
    def fit(cls, samples: dict[str, str], most_symbols: int = 24_000) -> Parser:
        languages = sorted(samples)
        chosen = "".join(sorted({_folded(p) for text in samples.values() for p in map(ord, set(text))}))
        letters = letter_table(chosen)
        width = _FIRST + len(chosen)
        table, roots, bits = SparseTable(), [], []
        automata = []
        for name in languages:
            codes = symbols(samples[name], letters)[:most_symbols]
            follow = suffix_automaton(codes)
            roots.append(table.add(follow, width))
            automata.append(follow[0])
            bits.append(np.log2(max(2, len(codes))))
        cells = table.cells(width)
        base = np.array(roots, np.int64)
        anew = np.repeat(base[:, None], width, 1)
        lacks = np.ones(anew.shape, np.int64)
        for k, first in enumerate(automata):
            for s in first:
                anew[k, s], lacks[k, s] = cells[roots[k] + s] & _LOW, 0
        lacks[:, _FILL] = 0
        return cls(languages, letters, is_letter(), cells, base, anew, lacks, np.array(bits))

    def _step(self, state: np.ndarray, row: np.ndarray, root: np.ndarray, lang: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The states after a symbol each; ``found`` counts the phrases that end with it. Filling ends an open phrase."""
        cell = self.cells[state + row]
        after = cell & _LOW
        miss = np.flatnonzero(cell >> 32 != state)
        if len(miss):
            s, k = row[miss], lang[miss]
            found[miss] += (state[miss] != root[miss]) + self.lacks[k, s]
            after[miss] = self.anew[k, s]
        return after

    def _walk(self, k: int, state: int, lane: np.ndarray, before: np.ndarray) -> tuple[int, int, int]:
        """One piece in plain steps until its state is the one that ``before`` has there: (state, phrases, steps)."""
        cells, root, anew, lacks, n = memoryview(self.cells), int(self.roots[k]), self.anew[k], self.lacks[k], 0
        for t, (s, known) in enumerate(zip(lane.tolist(), before.tolist())):
            c = cells[state + s]
            if c >> 32 == state:
                state = c & _LOW
            else:
                n += (state != root) + int(lacks[s])
                state = int(anew[s])
            if state == known:
                return state, n, t + 1
        return state, n, 0

    def _block(self, laid: np.ndarray, goes_on: np.ndarray, carried: np.ndarray, langs: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each lane (language, lane) and the states after the last one.

        Lanes are parsed from the root side by side. A lane that goes on with its forerunner's text is parsed again from
        the forerunner's last state, until it is where it was; that is soon, and what follows is known.
        """
        lanes, chunk = laid.shape
        n = len(langs) * lanes
        lang, lane = np.repeat(langs, lanes), np.tile(np.arange(lanes), len(langs))
        root = self.roots[lang]
        steps = np.ascontiguousarray(laid.T)
        states, counts = np.empty((chunk, n), np.int64), np.empty((chunk, n), np.int32)
        state, found = root.copy(), np.zeros(n, np.int32)
        for t in range(chunk):
            state = self._step(state, steps[t][lane], root, lang, found)
            states[t], counts[t] = state, found
        total, end = found.copy(), state.copy()
        follows = np.flatnonzero(goes_on[lane])
        used = root.copy()  # the state from which a lane was last parsed
        for k in range(rounds):
            enter = np.where(lane[follows] > 0, end[follows - 1], np.repeat(carried, lanes)[follows])
            todo = follows[enter != used[follows]]
            if not len(todo):
                break
            used[todo] = enter[enter != used[follows]]
            state, found, open_ = used[todo].copy(), np.zeros(len(todo), np.int32), todo
            for t in range(chunk):
                state = self._step(state, steps[t][lane[open_]], root[open_], lang[open_], found)
                same = state == states[t, open_]
                if same.any():
                    done = open_[same]
                    total[done] = found[same] + counts[-1, done] - counts[t, done]
                    end[done] = states[-1, done]
                    open_, state, found = open_[~same], state[~same], found[~same]
                    if not len(open_):
                        break
            total[open_], end[open_] = found, state
        else:  # long texts whose parses never meet: one after another
            for i in follows.tolist():
                enter = int(end[i - 1] if lane[i] else carried[i // lanes])
                if enter != used[i]:
                    used[i] = enter
                    here, n_new, t = self._walk(int(lang[i]), enter, laid[lane[i]], states[:, i])
                    total[i], end[i] = (n_new + counts[-1, i] - counts[t - 1, i], states[-1, i]) if t else (n_new, here)
        shape = (len(langs), lanes)
        return total.reshape(shape), end.reshape(shape)[:, -1]

    def phrases(self, texts: list[np.ndarray], chunk: int = 256, most_lanes: int = 4096, at_once: int = 4, rounds: int = 8) -> np.ndarray:
        """Phrases of each text by language. Only ``most_lanes`` pieces of ``chunk`` symbols are parsed at a time."""
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = np.where(sizes > 0, sizes // chunk + 1, 0)  # some filling after each text ends its last phrase
        total = int(lanes.sum())
        out = np.zeros((len(texts), len(self.languages)))
        if not total or not self.languages:
            return out
        laid = np.zeros(total * chunk, np.int32)
        first = np.cumsum(lanes) - lanes
        for t, a in zip(texts, (first * chunk).tolist()):
            laid[a : a + len(t)] = t
        laid = laid.reshape(total, chunk)
        owner = np.repeat(np.arange(len(texts)), lanes)
        goes_on = np.ones(total, bool)
        goes_on[first[lanes > 0]] = False
        for g in range(0, len(self.languages), at_once):
            langs = np.arange(g, min(g + at_once, len(self.languages)))
            carried = self.roots[langs]
            for a in range(0, total, most_lanes):
                b = min(total, a + most_lanes)
                found, carried = self._block(laid[a:b], goes_on[a:b], carried, langs, rounds)
                for k, row in zip(langs.tolist(), found):
                    out[:, k] += np.bincount(owner[a:b], row, len(texts))
        return out

    def _entropies(self, texts: list[str | None], least_phrase: float) -> tuple:
        """Bits a symbol of each text by language, its symbols, whether it has a letter, and whether its best language fits."""
        plain = [points(t) if t else np.empty(0, np.uint32) for t in texts]
        known = np.array([bool(self.alphabetic[p].any()) for p in plain], bool)
        coded = [symbols(p, self.letters) for p in plain]
        sizes = np.maximum(1, np.array([len(c) for c in coded], np.int64))
        phrases = self.phrases(coded)
        entropy = phrases * self.bits / sizes[:, None]
        best = entropy.argmin(1)
        fits = (phrases[np.arange(len(texts)), best] - 1) * least_phrase <= sizes
        return entropy, best, sizes, known, fits

    @staticmethod
    def _near(entropy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        worse = (entropy - entropy.min(1, keepdims=True)) * np.minimum(sizes, 40)[:, None]
        return np.exp2(-np.minimum(worse, 60)).sum(1)

    def judge(self, texts: list[str | None], least_phrase: float = 2.0) -> tuple[list[str], list[float], np.ndarray]:
        """Language and confidence of each text, and whether that language fits; ``und`` and 0 where there is no letter.

        A language fits a text whose phrases, without the last, have ``least_phrase`` symbols or more on average.
        """
        if not self.languages or not texts:
            known = np.array([bool(t) and bool(self.alphabetic[points(t)].any()) for t in texts], bool)
            return [UNKNOWN] * len(texts), [0.0] * len(texts), known
        entropy, best, sizes, known, fits = self._entropies(texts, least_phrase)
        sure = 1 / self._near(entropy, sizes)
        return (
            [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())],
            [s if k else 0.0 for s, k in zip(sure.tolist(), known.tolist())],
            known & fits,
        )

    def nearest(self, texts: list[str | None], least_phrase: float = 2.0) -> list[pa.Array]:
        """What other groups of languages need to know: best language, its bits, how near the others are, size, letters, fit."""
        if not texts:
            return [pa.array([], t) for t in (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_())]
        entropy, best, sizes, known, fits = self._entropies(texts, least_phrase)
        names = [self.languages[b] for b in best.tolist()]
        return [pa.array(names, pa.string()), pa.array(entropy.min(1)), pa.array(self._near(entropy, sizes)), pa.array(sizes), pa.array(known), pa.array(fits)]


def labelled_sample(docs: DataFrame, per_language: int = 60, most_chars: int = 1500) -> DataFrame:
    """(lang, rank, text): a bounded sample of each language from rows with crc32(doc_id) % 4 != 2 and a language.

    At most ``per_language`` rows of a language are taken, and of a longer text ``most_chars`` characters from a place
    that a hash of the id names. Languages are counted first; a hash of the id then thins each one to about twice the
    number wanted before rows are ranked, so no language's rows meet in one task.
    """
    rows = docs.select(as_long("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and doc_id is not null")
    rows = rows.where(crc_bucket("doc_id", 4) != 2)
    steps = 1 << 30
    wanted = F.least(F.lit(steps), 1 + (F.lit(2.0 * steps * per_language) / F.col("n")).cast("long")).alias("wanted")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", wanted)
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(steps))
    few = attach(rows, counts, ["lang"], "language-counts", F.octet_length("lang") + 40, how="inner").where(place < F.col("wanted")).where(F.col("text").rlike(r"\p{L}"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.greatest(F.lit(1), F.length("text") - most_chars + 1).cast("long")).cast("int") + 1
    few = few.select("lang", "doc_id", F.substr("text", start, F.lit(most_chars)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "text"))
    return few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "rank", "text")


def _joined(rows: list[tuple[str, int, str]]) -> dict[str, str]:
    found: dict[str, list[tuple[int, str]]] = {}
    for lang, rank, text in rows:
        found.setdefault(lang, []).append((rank, text))
    return {k: " ".join(t for _, t in sorted(v)) for k, v in found.items()}


class Panel:
    """The parsers of all languages, in groups of at most ``at_once`` by code point, each group's tables in one row.

    Tasks fit the groups and write them; the driver holds one group at a time, about 1.3 MB a language.
    """

    def __init__(self, docs: DataFrame, most_symbols: int = 24_000, at_once: int = 64, **sample: int) -> None:
        self.spark = docs.sparkSession
        self.sample = materialise(labelled_sample(docs, **sample), "language-sample")
        names = self.sample.select("lang").distinct()
        self.n_languages = names.count()
        self.n_groups = max(1, -(-self.n_languages // at_once))
        self.most_symbols = most_symbols
        if self.n_groups == 1:
            return
        place = F.row_number().over(Window.orderBy("lang")) - 1  # a row a language
        grouped = self.sample.join(names.select("lang", F.floor(place / at_once).cast("int").alias("grp")), "lang")

        def build(rows: pa.Table) -> pa.Table:
            parser = Parser.fit(_joined([tuple(r.values()) for r in rows.select(["lang", "rank", "text"]).to_pylist()]), most_symbols)
            return pa.Table.from_pylist([{"grp": rows.column("grp")[0].as_py(), "parser": pickle.dumps(parser)}], schema=pa.schema([("grp", pa.int32()), ("parser", pa.binary())]))

        self.built = materialise(grouped.repartition(self.n_groups, "grp").groupBy("grp").applyInArrow(build, "grp int, parser binary"), "language-parsers")

    def parser(self, group: int = 0) -> Parser:
        if self.n_groups == 1:
            return Parser.fit(_joined([tuple(r) for r in self.sample.select("lang", "rank", "text").collect()]), self.most_symbols)
        return pickle.loads(self.built.where(F.col("grp") == group).first()["parser"])


_PART = "row long, lang_pred string, low double, near double, size long, known boolean, fits boolean"


def judged(docs: DataFrame, panel: Panel, names: tuple[str, str, str] = ("lang_pred", "score", "fits")) -> DataFrame:
    """``docs`` with columns for the language, its score and whether it fits, when there are more languages than one group holds.

    Rows are written with numbers; each group of languages is a pass over them that tells the best of the group and
    how near its others are, and the groups' results, a row each for a document, are put together by its number.
    """
    number = fresh_name("row", docs)
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "language-rows")
    parts = []
    for group in range(panel.n_groups):
        shared = docs.sparkSession.sparkContext.broadcast(panel.parser(group))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, most=1 << 20):
                    told = shared.value.nearest(batch.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(0), *told], names=[c.split()[0] for c in _PART.split(", ")])

        parts.append(materialise(rows.select(number, "text").mapInArrow(scan, _PART), "language-part"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy("row").agg(
        F.min_by(F.struct("lang_pred", "low", "size", "known", "fits"), F.struct("low", "lang_pred")).alias("b"), F.collect_list(F.struct("low", "near")).alias("all")  # a row a group
    )
    worse = lambda x: F.least((x["low"] - F.col("b.low")) * F.least(F.col("b.size"), F.lit(40)), F.lit(60.0))
    total = F.aggregate(F.sort_array("all"), F.lit(0.0), lambda t, x: t + x["near"] * F.pow(F.lit(2.0), -worse(x)))
    told = best.select(F.col("row").alias(number), F.when(F.col("b.known"), F.col("b.lang_pred")).otherwise(UNKNOWN).alias(names[0]), F.when(F.col("b.known"), 1 / total).otherwise(0.0).alias(names[1]), (F.col("b.known") & F.col("b.fits")).alias(names[2]))
    return rows.join(told, number).drop(number)


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, **options: int) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score.

    Texts that are null or have no letter are ``und`` with score 0. A null doc_id has a null held_out. Repeated rows
    give a row each. Without any labelled text all are ``und``. Ties go to the first language by code point. Up to
    ``at_once`` languages are one broadcast and one pass without a shuffle; more are parsed by group.
    """
    panel = Panel(docs, **options)
    if panel.n_groups > 1:
        found = judged(docs.select(as_long("doc_id"), "text"), panel)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(panel.parser())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, most=1 << 20):
                    names, scores, _ = shared.value.judge(batch.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=_OUT.names)

        found = docs.select(as_long("doc_id"), "text").mapInArrow(scan, _OUT)
    return found.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, **options: int) -> DataFrame:
    """The documents that are in a language, all columns, ``lang`` set to the predicted one.

    Rejected are texts without a letter, and texts that the best language does not fit, as its phrases have under two
    symbols on average: texts of other scripts and mere codes. Where no text is labelled there is nothing to compare with:
    documents with a letter stay and keep their ``lang``. Repeated rows are judged alike; an empty table stays empty. No
    shuffle, unless there are more languages than one group holds.
    """
    panel = Panel(docs, **options)
    found = fresh_name("language", docs)
    if panel.n_groups > 1:
        score, fits = fresh_name("score", docs), fresh_name("fits", docs)
        kept = judged(docs, panel, (found, score, fits)).where(F.col(fits)).drop(score, fits)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(panel.parser())

        @F.arrow_udf(T.StringType())
        def language(text: pa.Array) -> pa.Array:
            out: list[str | None] = []
            for piece in slices(pa.RecordBatch.from_arrays([text], names=["text"]), text=0, most=1 << 20):
                told, _, fits = shared.value.judge(piece.column(0).to_pylist())
                out += [name if ok else None for name, ok in zip(told, fits.tolist())]
            return pa.array(out, pa.string())

        # not deterministic to the optimizer, or filter and value would parse twice
        kept = docs.withColumn(found, language.asNondeterministic()("text")).where(F.col(found).isNotNull())
    return kept.drop(found) if not panel.n_languages else kept.select(*(F.col(found).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))
