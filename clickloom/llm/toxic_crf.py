"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Document labels become labelled tokens first: a word's form and its beginnings mark it toxic if they occur in toxic
training documents and hardly in clean ones. The field is trained on those tokens; forward-backward marginals are
then taken over every whole text, their spans are reported by offset, and a small logistic model turns a document's
marginals into a score. A text of any length is one chain: its words lie in several lanes of 256, and forward and
backward ratios are carried from lane to lane.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_long, crc_bucket, slices

_WORD = re.compile(r"[^\W_]+")
LANE = 256


def word_features(word: str) -> tuple[str, ...]:
    """Form, beginnings and ending of a word, whatever its case."""
    w = word.lower()
    return ("w=" + w, "a=" + w[:3], "b=" + w[:4], "c=" + w[:5], "d=" + w[:6], "e=" + w[:7], "s=" + w[-3:])


def lane_products(emit: np.ndarray, real: np.ndarray, moves: tuple[float, ...], starts: np.ndarray) -> np.ndarray:
    """(2, 2, lane): the product of each lane's steps to its last word, without the move to a chain's first word."""
    _, go, back, stay = moves
    one = np.ones(emit.shape[1])
    n = np.array([[one, 0 * one], [0 * one, one]])
    for t in range(len(emit)):
        e = np.where(real[t], emit[t], 1.0)
        clean, toxic = n[:, 0] + back * n[:, 1], (go * n[:, 0] + stay * n[:, 1]) * e
        if t == 0:
            clean, toxic = np.where(starts, n[:, 0], clean), np.where(starts, n[:, 1] * e, toxic)
        n = np.where(real[t], np.stack([clean, toxic], 1), n)
        if t % 8 == 7:  # ratios matter, not sizes
            n /= n.max((0, 1))
    return n


def chain_ratios(emit: np.ndarray, real: np.ndarray, moves: tuple[float, ...], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic to clean) by (step, lane) from the words' odds, and each lane's entering ratio.

    ``real`` marks steps that exist, ``starts`` the lanes that begin a chain; the others go on with the lane before
    them. With two labels, forward-backward needs one ratio a step in place of two sums. A chain of several lanes is
    carried over their borders by the product of each lane's steps, so the ratios are those of the whole chain.
    """
    first, go, back, stay = moves
    lanes = emit.shape[1]
    enter, leave = np.zeros(lanes), np.ones(lanes)
    split = np.flatnonzero(~starts)
    if len(split):
        held = np.unique(np.concatenate((split, split - 1)))
        product = np.ones((2, 2, lanes))
        product[:, :, held] = lane_products(emit[:, held], real[:, held], moves, starts[held])
        state = np.zeros(2)
        for k in held.tolist():
            if starts[k]:
                state = np.array([1.0, first])
            else:
                enter[k] = state[1] / state[0]
            state = state @ product[:, :, k]
            state = state / np.abs(state).max()
        after = np.ones(2)
        for k in held[::-1].tolist():
            if k + 1 >= lanes or starts[k + 1]:
                after = np.ones(2)
            leave[k] = after[1] / after[0]
            after = product[:, :, k] @ after
            after = after / np.abs(after).max()
    ahead, behind = np.zeros_like(emit), np.ones_like(emit)
    if len(emit):
        ahead[0] = emit[0] * np.where(starts, first, (go + stay * enter) / (1 + back * enter))
    for t in range(1, len(emit)):
        r = ahead[t - 1]
        ahead[t] = emit[t] * (go + stay * r) / (1 + back * r)
    if len(emit):
        behind[-1] = leave
    for t in range(len(emit) - 2, -1, -1):
        s = emit[t + 1] * behind[t + 1]
        behind[t] = np.where(real[t + 1], (back + stay * s) / (1 + go * s), leave)
    return ahead, behind, enter


@dataclass
class Layout:
    """Words of documents, one after another, laid out side by side in lanes of ``LANE`` steps."""

    step: np.ndarray
    lane: np.ndarray
    real: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Layout:
        place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        lanes = -(-counts // LANE)
        first = np.cumsum(lanes) - lanes
        step, lane = place % LANE, np.repeat(first, counts) + place // LANE
        real = np.zeros((min(LANE, int(counts.max(initial=0))), int(lanes.sum())), bool)
        real[step, lane] = True
        starts = np.zeros(real.shape[1], bool)
        starts[first[lanes > 0]] = True
        return cls(step, lane, real, starts)

    def lay(self, values: np.ndarray, kind: type = float) -> np.ndarray:
        out = np.zeros(self.real.shape, kind)
        out[self.step, self.lane] = values
        return out


def _odds(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores, -30, 30))


@dataclass
class Field:
    """weights: feature -> log odds of toxic against clean; moves: log potentials (first, go, back, stay)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    scale: tuple[float, float, float, float] = (-6.0, 0.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        w = word.lower()
        form, three, four, five, six, seven, ending = self._tables
        return self.bias + form(w, 0.0) + three(w[:3], 0.0) + four(w[:4], 0.0) + five(w[:5], 0.0) + six(w[:6], 0.0) + seven(w[:7], 0.0) + ending(w[-3:], 0.0)

    @functools.cached_property
    def _tables(self) -> list:
        """Lookups of each kind of feature, in the order of ``word_features``."""
        return [{f[2:]: x for f, x in self.weights.items() if f[0] == kind}.get for kind in "wabcdes"]

    def marginals(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(toxic) of each word; scores are the emissions of all documents' words, one after another."""
        at = Layout.of(counts)
        ahead, behind, _ = chain_ratios(at.lay(_odds(scores)), at.real, np.exp(self.moves), at.starts)
        odds = (ahead * behind)[at.step, at.lane]
        return odds / (1 + odds)

    def score(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-document_facts(p, counts) @ np.array(self.scale)))


def document_facts(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1, log of the expected number of toxic words, the surest one, and their share; zeros for no words."""
    out = np.zeros((len(counts), 4))
    out[:, 0] = 1
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        total = np.add.reduceat(p, starts)
        out[some, 1] = np.log1p(total)
        out[some, 2] = np.maximum.reduceat(p, starts)
        out[some, 3] = np.sqrt(total / counts[some])
    return out


def _shingles(tokens: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct hashes of runs of five words, given by their numbers; fewer words are one run."""
    n = max(1, len(tokens) - width + 1) if len(tokens) else 0
    out = np.zeros(n, np.uint64)
    for j in range(min(width, len(tokens))):
        x = (tokens[j : j + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def _similar(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, True))
    return both / (len(a) + len(b) - both)


def without_copies(documents: list[tuple[np.ndarray, int]], least: float = 0.8) -> list[tuple[np.ndarray, int]]:
    """Of documents (word numbers, label) with one label whose five-word shingles are ``least`` similar, the first.

    Only documents that share one of four least hashes are compared, by their whole texts. Those without a word go.
    """
    kept, held = [], {}
    odd = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
    for tokens, toxic in documents:
        mine = _shingles(tokens)
        if not len(mine):
            continue
        keys = [(toxic, j, int((mine * m).min())) for j, m in enumerate(odd)]
        near = {id(x): x for k in keys for x in held.get(k, ())}.values()
        if any(_similar(mine, x) >= least for x in near):
            continue
        kept.append((tokens, toxic))
        for k in keys:
            held.setdefault(k, []).append(mine)
    return kept


#: Kinds of features that may tell toxic words: not the shortest beginnings and the endings.
_TELLING = np.array([True, False, True, True, True, True, False])


def telling_features(documents: list[tuple[np.ndarray, int]], table: np.ndarray, n_features: int, least_ratio: float = 15.0, least_evidence: float = 8.0) -> np.ndarray:
    """Which features toxic documents have ``least_ratio`` times as often as clean ones, and not by chance.

    Evidence is the log likelihood ratio of a feature's documents being toxic at their own rate rather than at the
    rate of all documents; 8 leaves about three chance finds in ten thousand features.
    """
    seen, total = np.zeros((2, n_features)), np.zeros(2)
    for tokens, toxic in documents:
        seen[toxic][np.unique(table[np.unique(tokens)][:, _TELLING])] += 1
        total[toxic] += 1
    c, t = seen
    share = total[1] / max(1, total.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = t / (t + c)
        evidence = t * np.log(rate / share) + np.where(c > 0, c * np.log((1 - rate) / (1 - share)), 0.0)
    return (t > 0) & ((t + 0.5) / (total[1] + 1) >= least_ratio * (c + 0.5) / (total[0] + 1)) & (evidence >= least_evidence)


def _blocks(documents: list[tuple[np.ndarray, int]], most_words: int = 400_000) -> Iterator[list]:
    """Runs of documents with about so many words each, one document at least."""
    held, size = [], 0
    for tokens, toxic in documents:
        if held and size + len(tokens) > most_words:
            yield held
            held, size = [], 0
        held.append((tokens, toxic))
        size += len(tokens)
    if held:
        yield held


def train(documents: list[tuple[str, int]], rounds: int = 20, ridge: float = 0.02, rate: float = 0.4) -> Field:
    """Fit the field and the document model on (text, toxic) pairs: all words of all documents, near copies left out."""
    number: dict[str, int] = {}
    told = [(np.fromiter((number.setdefault(w, len(number)) for w in _WORD.findall(text.lower())), np.int32), int(toxic > 0)) for text, toxic in documents]
    kept = without_copies(told)
    model = Field()
    if not any(t for _, t in kept):
        return model
    names: dict[str, int] = {}
    table = np.array([[names.setdefault(f, len(names)) for f in word_features(w)] for w in number], np.int32)
    telling = telling_features(kept, table, len(names))
    if not telling.any():
        return model
    marked = telling[table].any(1)
    parts, uses = [], np.zeros(len(number), np.int64)
    for block in _blocks(kept):
        tokens, counts = np.concatenate([t for t, _ in block]), np.array([len(t) for t, _ in block], np.int64)
        uses += np.bincount(tokens, minlength=len(number))
        parts.append((tokens, counts, Layout.of(counts), np.repeat([toxic > 0 for _, toxic in block], counts)))
    often = np.bincount(table.ravel(), np.repeat(uses, table.shape[1]), len(names)) >= 2
    table = np.where(often[table], table, len(names))  # a feature met once has no weight
    weights, bias, moves = np.zeros(len(names) + 1), -4.0, np.zeros(4)
    m, v = np.zeros(len(names) + 6), np.zeros(len(names) + 6)
    n = sum(len(tokens) for tokens, *_ in parts)
    for k in range(1, rounds + 1):
        word_odds = np.exp(np.clip(bias + weights[table].sum(1), -15, 15)).astype(np.float32)  # products stay in range
        error, gap = np.zeros(len(number)), np.zeros(4)
        for tokens, _, at, toxic in parts:
            truth = marked[tokens] & toxic
            emit = at.lay(word_odds[tokens], np.float32)
            ahead, behind, enter = chain_ratios(emit, at.real, np.exp(moves), at.starts)
            s, r = emit * behind, np.concatenate((enter[None], ahead[:-1])).astype(np.float32)
            pairs = at.real.copy()
            pairs[0] &= ~at.starts
            go, back, stay = np.exp(moves[1:]).astype(np.float32)
            both = s * r * stay
            share = pairs / (1 + go * s + back * r + both)
            p = ahead * behind
            p /= 1 + p
            laid = at.lay(truth, bool)
            before = np.concatenate((np.roll(laid[-1], 1)[None], laid[:-1]))  # a lane that is continued is full
            seen = np.array([laid[0][at.starts].sum(), (~before & laid & pairs).sum(), (before & ~laid & pairs).sum(), (before & laid & pairs).sum()])
            gap += seen - np.array([p[0][at.starts].sum(), go * (s * share).sum(), back * (r * share).sum(), (both * share).sum()])
            error += np.bincount(tokens, truth - p[at.step, at.lane], len(number))
        slope = np.bincount(table.ravel(), np.repeat(error, table.shape[1]), len(names) + 1)
        slope[-1] = 0
        gradient = np.concatenate((slope - ridge * weights, [error.sum()], gap - ridge * moves)) / n
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        weights, bias, moves = weights + move[: len(weights)], bias + move[len(weights)], moves + move[len(weights) + 1 :]
        weights[-1] = 0
    weights[np.abs(weights) <= 1e-3] = 0
    model.weights = {f: float(weights[k]) for f, k in names.items() if weights[k]}
    model.bias, model.moves = float(bias), tuple(moves.tolist())
    word_scores = bias + weights[table].sum(1)
    facts = np.concatenate([document_facts(model.marginals(word_scores[tokens], counts), counts) for tokens, counts, *_ in parts])
    target, beta = np.array([t for _, t in kept], float), np.zeros(4)
    for _ in range(30):  # Newton's steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(facts @ beta, -30, 30)))
        hessian = (facts * (q * (1 - q))[:, None]).T @ facts + 0.05 * np.eye(4)
        move = np.linalg.solve(hessian, facts.T @ (target - q) - 0.05 * beta)
        beta = beta + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-7:
            break
    model.scale = tuple(beta.tolist())
    return model


class Emissions(dict):
    """word -> emission, computed when first met; emptied when it grows large. Long words are not remembered."""

    def __init__(self, model: Field, most: int = 500_000) -> None:
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        value = self.model.emission(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def training_documents(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_clean: int = 3000, most_chars: int = 20_000) -> list[tuple[str, int]]:
    """A bounded sample of labelled documents with crc32(doc_id) % 3 != 1, least hash of the id first.

    At most ``most_toxic + most_clean`` documents are fetched, and of a text of more than ``most_chars`` characters so
    many from a place that a hash of the id names. A document with both labels is toxic; of an id with several texts
    the least is read.
    """
    known = labels.select(as_long("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(crc_bucket("doc_id", 3) != 1).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = known.withColumn("place", F.xxhash64("doc_id", F.lit(5)))
    order = ("place", "doc_id")
    sample = known.where("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(most_clean))
    texts = docs.select(as_long("doc_id"), "text").where("text is not null").join(F.broadcast(sample), "doc_id")  # the sample's bound bounds the broadcast
    start = F.pmod(F.xxhash64("doc_id", F.lit(15)), F.greatest(F.lit(1), F.length("text") - most_chars + 1).cast("long")).cast("int") + 1
    rows = texts.select("doc_id", "place", "toxic", F.substr("text", start, F.lit(most_chars)).alias("text"))
    rows = rows.groupBy("place", "doc_id", "toxic").agg(F.min("text").alias("text"))
    return [(text, toxic) for _, _, text, toxic in sorted((r["place"], r["doc_id"], r["text"], r["toxic"]) for r in rows.toLocalIterator())]


_TAGGED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("toxic_words", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def _spans(text: str, p: np.ndarray, least: float) -> list[list[int]]:
    """Character ranges [start, end) of runs of words that are toxic with ``least`` probability."""
    out: list[list[int]] = []
    before = -2
    wanted = set(np.flatnonzero(p >= least).tolist())
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            if before == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            before = k
    return out


def tag(docs: DataFrame, model: Field, least: float = 0.5) -> DataFrame:
    """doc_id, score, expected number of toxic words, and the offending character spans of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model))  # a fresh copy: bound lookups do not travel

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = Emissions(model)
        get = memo.__getitem__
        for whole in batches:
            for batch in slices(whole, most=4 << 20):
                memo.trim()
                texts = [t or "" for t in batch.column(1).to_pylist()]
                words = [_WORD.findall(t) for t in texts]
                counts = np.fromiter(map(len, words), np.int64, len(words))
                scores = np.fromiter((x for w in words for x in map(get, w)), float, int(counts.sum()))
                p = model.marginals(scores, counts)
                facts, ends = document_facts(p, counts), np.cumsum(counts)
                spans: list[list[list[int]]] = [[] for _ in texts]
                for k in np.flatnonzero(facts[:, 2] >= least).tolist():
                    spans[k] = _spans(texts[k], p[ends[k] - counts[k] : ends[k]], least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(model.score(p, counts)), pa.array(np.expm1(facts[:, 1])), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                    names=_TAGGED.names,
                )

    return docs.select(as_long("doc_id"), "text").mapInArrow(scan, _TAGGED)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **sample: int) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, toxic_words, spans.

    Null and empty texts have no words and the score of a text without toxic words. A null doc_id has a null
    held_out. Repeated rows give a row each; without a toxic training document every score is that of no toxic words.
    """
    model = train(training_documents(docs, labels, **sample))
    return tag(docs, model).select(
        "doc_id",
        (crc_bucket("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "toxic_words",
        "spans",
    )
