"""Weak supervision of text quality: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Signals of every whole text are counted once and written. The rules are column expressions over them; Spark counts
the vote patterns (at most 3 to the number of rules), EM runs on those counts, and the posterior is again a column
expression, so no row leaves the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, as_long, materialise, payloads, slices

GOOD, BAD, ABSTAIN = 1, -1, 0
_SYMBOLS = b"#*$%&|<>"
_NO_CHAR = WHITE + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a code point
_ENDS = (b".", b"!", b"?", b'"', b"\xe2\x80\xa6", b"\xe2\x80\x9d", b":", b";")
_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_end_lines", "n_alpha_words", "n_short_words"]
_SIGNALS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(x, T.LongType()) for x in _FIELDS)])


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words inside ``width``-word windows that occur at least twice in the text, the first occurrence included.

    Windows are compared by 64-bit hashes of exact word numbers.
    """
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    if len(number) == n:
        return 0
    x = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    m = n - width + 1
    h = np.zeros(m, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x94D049BB133111EB) + x[j : j + m]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_signals(data: bytes, window: int = 8) -> tuple[int, ...]:
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(_FIELDS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (
        n,
        len(data.translate(None, _NO_CHAR)),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words, window),
        len(lines),
        sum(x.rstrip().endswith(_ENDS) for x in lines),
        sum(map(bytes.isalpha, data.translate(_LETTERS_ONLY).split())),
        sum(len(w) <= 3 for w in words),
    )


#: For counting words of letters: bytes of multi-byte characters count as letters, final marks vanish into blanks.
_LETTERS_ONLY = bytes(0x61 if c >= 0x80 else 0x20 if c in b".,;:!?\"'()-" else c for c in range(256))


def signals(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id and the counts of every whole text; null texts count as empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = np.array([text_signals(x, window) for x in payloads(batch.column(1))], np.int64).reshape(batch.num_rows, len(_FIELDS))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(_FIELDS)))], names=_SIGNALS.names)

    return docs.select(as_long("doc_id"), "text").mapInArrow(scan, _SIGNALS)


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Callable[[], Column]
    good: Callable[[], Column]

    def vote(self) -> Column:
        return F.when(self.bad(), BAD).when(self.good(), GOOD).otherwise(ABSTAIN).alias(self.name)


def _per(column: str, base: str, factor: float) -> Column:
    return F.col(column) > factor * F.col(base)


RULES = (
    Rule("length", lambda: F.col("n_words") < 20, lambda: F.col("n_words") >= 60),
    Rule("word_length", lambda: (F.col("word_chars") > 14 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")), lambda: F.col("word_chars").between(3 * F.col("n_words"), 9 * F.col("n_words"))),
    Rule("symbols", lambda: _per("n_symbols", "n_words", 0.1), lambda: ~_per("n_symbols", "n_words", 0.02)),
    Rule("repeated_lines", lambda: _per("n_dup_lines", "n_lines", 0.3) & (F.col("n_dup_lines") > 2), lambda: (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 3)),
    Rule("repeated_spans", lambda: _per("n_repeat_words", "n_words", 0.25), lambda: (F.col("n_repeat_words") == 0) & (F.col("n_words") >= 60)),
    Rule("short_words", lambda: ~_per("n_short_words", "n_words", 0.05), lambda: _per("n_short_words", "n_words", 0.15)),
    Rule("line_ends", lambda: ~_per("n_end_lines", "n_lines", 0.1), lambda: _per("n_end_lines", "n_lines", 0.6)),
    Rule("letters", lambda: ~_per("n_alpha_words", "n_words", 0.6), lambda: _per("n_alpha_words", "n_words", 0.85)),
)


@dataclass(frozen=True)
class LabelModel:
    """prior: P(good); per rule, how often its vote is right on good and on bad documents."""

    prior: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def posterior(self) -> Column:
        """P(good | votes) of a row that has a column of votes for each rule."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, a in self.on_good.items():
            b = self.on_bad[name]
            odds = odds + F.when(F.col(name) == GOOD, math.log(a / (1 - b))).when(F.col(name) == BAD, math.log((1 - a) / b)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 300) -> LabelModel:
    """EM over vote patterns (rows of -1, 0, 1) and how many documents have each.

    A rule has an accuracy on good and one on bad documents, as most rules know one kind of bad text and pass the
    others; abstaining says nothing. The bounds keep the classes' meaning: a rule rarely condemns good text, and
    condemns at least some of the bad.
    """
    on_good, on_bad, prior = np.full(votes.shape[1], 0.97), np.full(votes.shape[1], 0.5), 0.85
    good_vote, bad_vote = votes > 0, votes < 0
    for _ in range(rounds):
        odds = math.log(prior / (1 - prior)) + good_vote @ np.log(on_good / (1 - on_bad)) + bad_vote @ np.log((1 - on_good) / on_bad)
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        g, b = good * counts, (1 - good) * counts
        fresh_good = np.clip((g @ good_vote + 8) / (g @ (good_vote | bad_vote) + 8.3), 0.9, 0.9995)
        fresh_bad = np.clip((b @ bad_vote + 4) / (b @ (good_vote | bad_vote) + 8), 0.2, 0.95)
        share = float(np.clip((g.sum() + 8) / (counts.sum() + 10), 0.05, 0.98))
        moved = max(np.abs(fresh_good - on_good).max(), np.abs(fresh_bad - on_bad).max(), abs(share - prior))
        on_good, on_bad, prior = fresh_good, fresh_bad, share
        if moved < 1e-9:
            break
    return LabelModel(prior, dict(zip(names, on_good.tolist())), dict(zip(names, on_bad.tolist())))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 20, most_repeats: float = 0.3, threshold: float = 0.5) -> DataFrame:
    """One row per document row: counts, votes, posterior, base_failed, kept.

    Null and empty texts have no words and fail the base. Repeated rows give a row each; other columns are not read.
    An empty table gives no rows. The corpus may be of any size: EM sees vote patterns only.
    """
    names = [r.name for r in rules]
    voted = materialise(signals(docs).select("*", *(r.vote() for r in rules)), "quality")
    patterns = voted.where("n_words > 0").groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    votes = np.array([[r[n] for n in names] for r in patterns], np.float64).reshape(len(patterns), len(names))
    model = fit_label_model(votes, np.array([r["count"] for r in patterns], np.float64), names)
    failed = (F.col("n_words") < least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(round(100 * most_repeats)) * F.col("n_words"))
    return voted.select("*", model.posterior().alias("posterior"), failed.alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )
