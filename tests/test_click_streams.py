"""State kept over a stream against the same events as one table."""

import math
import random
from datetime import datetime, timedelta

import pytest

from clickloom.streaming.profiles import visitor_profiles, write_profiles

T0 = datetime(2024, 3, 1)
SCHEMA = "cookie_id long, event_id long, event_ts timestamp, event_name string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def brute(events):
    """Profile of one visitor's events in order of (time, id)."""
    events = sorted(events, key=lambda e: (e[2], e[1]))
    gaps = [(b[2] - a[2]).total_seconds() for a, b in zip(events, events[1:])]
    names = [e[3] for e in events]
    pairs, best, run = {}, (0, None), 0
    for k, name in enumerate(names):
        run = run + 1 if k and names[k - 1] == name else 1
        if run > best[0]:
            best = (run, name)
        if k:
            pairs[f"{names[k - 1]}>{name}"] = pairs.get(f"{names[k - 1]}>{name}", 0) + 1
    mean = sum(gaps) / len(gaps) if gaps else None
    std = math.sqrt(sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)) if len(gaps) > 1 else None
    return len(events), mean, std, best[0], best[1], pairs


def run(spark, folder, checkpoint, source):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = write_profiles(visitor_profiles(stream, quiet=1800, late="10 minutes"), folder, checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_profiles_equal_the_whole_table_over_restarts(rocks, tmp_path):
    rng = random.Random(7)
    rows = [(v, 1000 * v + k, T0 + timedelta(seconds=60 * k + rng.randrange(50)), rng.choice("abb")) for v in range(6) for k in range(rng.randrange(1, 40))]
    rows.sort(key=lambda r: r[2])
    source = f"{tmp_path}/in"
    cut = [rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]]
    for k, part in enumerate(cut):  # each after a restart from the checkpoint
        if k == 1:  # one behind its visitor's last event, but not behind the watermark
            last = max((r for r in cut[0]), key=lambda r: r[2])
            behind = (last[0], 1, last[2] - timedelta(seconds=1), "late")
            part = part + [behind]
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(rocks, f"{tmp_path}/out", f"{tmp_path}/check", source)
    end = [(99, 1, T0 + timedelta(hours=9), "end"), (99, 2, T0 + timedelta(hours=19), "end")]
    for e in end:  # the watermark passes all timers
        rocks.createDataFrame([e], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(rocks, f"{tmp_path}/out", f"{tmp_path}/check", source)
    got = {r["cookie_id"]: r for r in rocks.read.parquet(f"{tmp_path}/out/profile").collect() if r["cookie_id"] != 99}
    assert set(got) == {r[0] for r in rows}
    for v, r in got.items():
        n, mean, std, longest, name, pairs = brute([e for e in rows if e[0] == v])
        assert (r["n_events"], r["longest_run"], r["run_name"], r["transitions"]) == (n, longest, name, pairs)
        assert r["gap_mean"] == (mean if mean is None else pytest.approx(mean)) and r["gap_std"] == (std if std is None else pytest.approx(std))
    late = rocks.read.parquet(f"{tmp_path}/out/late").collect()
    assert [(r["cookie_id"], r["event_id"], r["event_name"]) for r in late] == [(behind[0], 1, "late")]
