"""A visitor's behaviour kept in state: transitions, runs and gaps of a stream of events, told when the visitor is quiet."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: ``kind`` is profile or late; a late row has only cookie_id, event_id, event_ms and event_name.
ROWS = (
    "kind string, cookie_id long, n_events long, first_ms long, last_ms long, gap_mean double, gap_std double, gap_max long, longest_run long, run_name string, "
    "transitions map<string, long>, event_id long, event_ms long, event_name string"
)
_NAMES = [c.split()[0] for c in ROWS.replace("map<string, long>", "map").split(", ")]
_STATE = "n long, first long, last long, last_id long, name string, gap_sum double, gap_square double, gap_max long, run long, best long, best_name string"


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Rows with None, and not NaN, for what they lack."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in _NAMES})


class _Visitor(StatefulProcessor):
    """Counts of one visitor. Events of a batch are taken in the order of (time, event_id); one that lies before the last
    taken one is late. A timer ``quiet_ms`` after the newest event tells the profile and clears the state."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", _STATE)
        self.pairs = handle.getMapState("pairs", "pair string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["event_ms", "event_id"], kind="stable")  # a visitor's share of a batch
        s = list(self.facts.get()) if self.facts.exists() else None
        late, pairs, before = [], {}, s[2] if s else None
        for at, i, name in zip(events["event_ms"].tolist(), events["event_id"].tolist(), events["event_name"].tolist()):
            if s is None:
                s = [1, at, at, i, name, 0.0, 0.0, 0, 1, 1, name]
                continue
            if (at, i) <= (s[2], s[3]):
                late.append({"kind": "late", "cookie_id": key[0], "event_id": i, "event_ms": at, "event_name": name})
                continue
            gap = (at - s[2]) / 1000
            pair = f"{s[4]}>{name}"
            pairs[pair] = pairs.get(pair, 0) + 1
            run = s[8] + 1 if name == s[4] else 1
            best, best_name = (run, name) if run > s[9] else (s[9], s[10])
            s = [s[0] + 1, s[1], at, i, name, s[5] + gap, s[6] + gap * gap, max(s[7], at - s[2]), run, best, best_name]
        for pair, n in pairs.items():
            known = self.pairs.getValue((pair,)) if self.pairs.containsKey((pair,)) else (0,)
            self.pairs.updateValue((pair,), (known[0] + n,))
        if s is not None:
            self.facts.update(tuple(s))
            if s[2] != before:
                if before is not None:
                    self.handle.deleteTimer(before + self.quiet_ms)
                self.handle.registerTimer(s[2] + self.quiet_ms)
        yield _frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.facts.exists():
            return
        n, first, last, _, _, total, square, gap_max, _, best, best_name = self.facts.get()
        gaps = n - 1
        mean = total / gaps if gaps else None
        std = math.sqrt(max(square - gaps * mean * mean, 0.0) / (gaps - 1)) if gaps > 1 else None
        told = {"kind": "profile", "cookie_id": key[0], "n_events": n, "first_ms": first, "last_ms": last, "gap_mean": mean, "gap_std": std, "gap_max": gap_max if gaps else None, "longest_run": best, "run_name": best_name}
        told["transitions"] = {k[0]: v[0] for k, v in self.pairs.iterator()}
        self.facts.clear()
        self.pairs.clear()
        yield _frame([told])

    def close(self) -> None:
        pass


def visitor_profiles(events: DataFrame, quiet: int = 1800, late: str = "1 hour") -> DataFrame:
    """A stream of profiles and late rows of a stream ``events(cookie_id, event_id, event_ts, event_name)``.

    A profile has the number of events, first and last time, mean, deviation and maximum of the gaps in seconds (the
    maximum in ms), the longest run of one event name and the counts of transitions. It is told once no event has come for
    ``quiet`` seconds of event time; a visitor who comes back begins anew. Events that lie before one that was taken are
    told as they are; those behind the watermark never arrive here. NULL visitors and times are left out. The state of a
    visitor is a row and its distinct transitions. Needs the RocksDB state store.
    """
    rows = events.where("cookie_id IS NOT NULL AND event_ts IS NOT NULL").select(
        F.col("cookie_id").cast("long").alias("cookie_id"), F.col("event_id").cast("long").alias("event_id"), F.coalesce("event_name", F.lit("?")).alias("event_name"), F.col("event_ts").cast("timestamp").alias("event_time")
    )
    rows = rows.withColumn("event_ms", F.unix_millis("event_time")).withWatermark("event_time", late)
    return rows.groupBy("cookie_id").transformWithStateInPandas(statefulProcessor=_Visitor(quiet * 1000), outputStructType=ROWS, outputMode="Append", timeMode="EventTime")


def write_profiles(profiles: DataFrame, folder: str, checkpoint: str):
    """Profiles to ``folder``/profile and late rows to ``folder``/late, a folder a batch, which a batch done twice overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind in ("profile", "late"):
            batch.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{folder}/{kind}/batch={number}")
        batch.unpersist()

    return profiles.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
