"""Settings found by a tree-structured Parzen search: each trial is drawn where good trials are dense and bad ones are not."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import KEY
from ..sources.readers import append_results, read_results, write_settings
from .metrics import average_precision
from .models import LEARNERS, estimate_rounds, fit, out_of_fold, predict


@dataclass(frozen=True)
class Range:
    """A setting's range. ``less`` names an earlier setting that is taken off ``high``; whole numbers are rounded."""

    low: float
    high: float
    log: bool = False
    whole: bool = False
    less: str = ""

    def top(self, drawn: dict[str, float]) -> float:
        return self.high - (drawn[self.less] if self.less else 0.0)

    def place(self, value: float, drawn: dict[str, float]) -> float:
        """Where a value lies between the ends, 0 to 1."""
        f = np.log if self.log else float
        return float((f(value) - f(self.low)) / ((f(self.top(drawn)) - f(self.low)) or 1.0))

    def value(self, place: float, drawn: dict[str, float]) -> float:
        f, back = (np.log, np.exp) if self.log else (float, float)
        x = float(back(f(self.low) + place * (f(self.top(drawn)) - f(self.low))))
        x = min(max(x, self.low), self.top(drawn))
        return int(round(x)) if self.whole else x


# The ranges that the learners are tuned over, in the order in which they are drawn.
SPACES: dict[str, dict[str, Range]] = {
    "gbt": {
        "top": Range(0.05, 0.5),
        "rate": Range(0.03, 0.12, log=True),
        "depth": Range(4, 7, whole=True),
        "min_rows": Range(10, 120, whole=True),
        "columns_share": Range(0.3, 0.95),
        "other": Range(0.02, 0.9, less="top"),
        "l1": Range(1e-3, 10.0, log=True),
        "l2": Range(1e-2, 50.0, log=True),
        "min_gain": Range(0.0, 1.0),
    },
    "spark_gbt": {
        "stepSize": Range(0.03, 0.12, log=True),
        "maxDepth": Range(3, 9, whole=True),
        "minInstancesPerNode": Range(1, 30, log=True, whole=True),
        "subsamplingRate": Range(0.6, 1.0),
    },
    "forest": {"maxDepth": Range(4, 8, whole=True), "minInstancesPerNode": Range(1, 30, log=True, whole=True), "subsamplingRate": Range(0.3, 0.95)},
    "linear": {"regParam": Range(1e-3, 10.0, log=True), "elasticNetParam": Range(0.0, 1.0)},
}


class Density:
    """A mixture of normals on [0, 1]: one at each point, as wide as its farther neighbour is away, and a flat one."""

    def __init__(self, points: list[float]) -> None:
        middle = np.array([*points, 0.5])
        order = np.argsort(middle, kind="stable")
        edges = np.concatenate(([0.0], middle[order], [1.0]))
        wide = np.empty(len(middle))
        wide[order] = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        self.middle, self.wide = middle, np.clip(wide, 1.0 / min(100, len(middle) + 1), 1.0)
        self.wide[-1] = 1.0

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(0)
        while len(out) < n:
            k = rng.integers(len(self.middle), size=n)
            x = rng.normal(self.middle[k], self.wide[k])
            out = np.concatenate((out, x[(x >= 0) & (x <= 1)]))
        return out[:n]

    def log(self, x: np.ndarray) -> np.ndarray:
        from math import erf

        inside = np.array([(erf((1 - m) / w / 2**0.5) - erf((0 - m) / w / 2**0.5)) / 2 for m, w in zip(self.middle, self.wide)])
        each = np.exp(-0.5 * ((x[:, None] - self.middle) / self.wide) ** 2) / (self.wide * (2 * np.pi) ** 0.5 * inside)
        return np.log(each.mean(1) + 1e-300)


def propose(space: dict[str, Range], trials: list[tuple[dict, float]], seed: int, startup: int = 8, candidates: int = 24) -> dict:
    """The settings of the next trial; the same trials and seed give the same.

    After ``startup`` random trials, the best tenth of the trials and the rest give two densities for each setting, and of
    ``candidates`` drawn from the first the one with the largest ratio is taken.
    """
    rng = np.random.default_rng((seed, len(trials)))
    drawn: dict[str, float] = {}
    ranked = sorted(trials, key=lambda t: -t[1])
    n_good = min(int(np.ceil(0.1 * len(ranked))), 25)
    for name, range_ in space.items():
        if len(trials) < startup:
            place = rng.random()
        else:
            good, bad = ([range_.place(t[name], t) for t, _ in part] for part in (ranked[:n_good], ranked[n_good:]))
            better, worse = Density(good), Density(bad)
            x = better.draw(rng, candidates)
            place = x[int(np.argmax(better.log(x) - worse.log(x)))]
        drawn[name] = range_.value(float(place), drawn)
    return drawn


def parzen_search(objective: Callable[[dict], float], space: dict[str, Range], trials: int, seed: int = 42, spark: SparkSession | None = None, folder: str = "", startup: int = 8) -> list[tuple[dict, float]]:
    """Trials in the order they were made, (settings, value); larger is better.

    With ``folder`` each trial is a row of a table there, and a search that was broken off goes on after the last one.
    """
    done: list[tuple[dict, float]] = []
    if folder:
        try:
            rows = read_results(spark, folder).orderBy("trial").collect()  # a row a trial
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = []
        done = [(json.loads(r["settings"]), r["value"]) for r in rows]
    while len(done) < trials:
        settings = propose(space, done, seed, startup)
        value = float(objective(settings))
        if folder:
            append_results(spark.createDataFrame([(len(done), json.dumps(settings), value)], "trial long, settings string, value double").coalesce(1), folder)
        done.append((settings, value))
    return done


def chained_precision(df: DataFrame, columns: list[str], learner: str, cuts: tuple[int, ...], seed: int) -> float:
    """Mean average precision of models of the days before each cut on the days from it on."""
    found = []
    for cut in cuts:
        before, after = df.where(F.col("day_index") < cut), df.where(F.col("day_index") >= cut)
        scores = predict(fit(before, columns, learner, seed), after, columns).join(after.select(KEY, F.col("target").alias("y")), KEY)
        found.append(average_precision(scores.select("y", F.round("score", 12).alias("s"))).first()[0] or 0.0)
    return sum(found) / len(found)


def tune(df: DataFrame, columns: list[str], learner: str = "gbt", trials: int = 25, k: int = 3, temporal: float = 0.5, cuts: tuple[int, ...] = (7, 9, 11), most_rounds: int = 60, seed: int = 42, folder: str = "", out: str = "") -> dict:
    """The best settings of a learner: ``temporal`` of a trial's value is that on later days, the rest that over folds.

    Boosted trees take the rounds that rank a fold best. With ``out`` the result is written there as settings.
    """
    base = LEARNERS[learner]

    def objective(settings: dict) -> float:
        name = f"{learner}:trial"
        LEARNERS[name] = lambda s: base(s).setParams(**settings)
        try:
            if learner == "gbt":
                rounds = estimate_rounds(df, columns, k, most_rounds, 10, seed, name)
                LEARNERS[name] = lambda s: base(s).setParams(**settings, rounds=rounds)
            scores = out_of_fold(df, columns, name, k, seed).join(df.select(KEY, F.col("target").alias("y")), KEY)
            random = average_precision(scores.select("y", F.round("score", 12).alias("s"))).first()[0] or 0.0
            return random if not temporal else (1 - temporal) * random + temporal * chained_precision(df, columns, name, cuts, seed)
        finally:
            del LEARNERS[name]

    found = parzen_search(objective, SPACES[learner], trials, seed, df.sparkSession, folder)
    settings, value = max(found, key=lambda t: t[1])
    told = {"learner": learner, "settings": settings, "value": value, "trials": len(found)}
    if out:
        write_settings(df.sparkSession, told, out)
    return told
