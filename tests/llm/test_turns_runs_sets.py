"""Turn repair, periodic runs and the set join against brute force and edge cases."""

import functools
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from clickloom.llm import parity, periodic, turn_repair
from clickloom.llm.queries import damaged, planted, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, key string, id string, runs string, component_id string"


def docs(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(ids[i] if ids else i, t, "k", "i", "r", "c") for i, t in enumerate(texts)], DOCS)


# Turns

GRAMMAR = re.compile(r"(s?(ua)+)?")


STEPS = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}


def brute_repair(initials, faults):
    """The least (cost, audit) over all edits, by what the rest of the turns costs from each last role on."""

    @functools.lru_cache(None)
    def rest(i, last, inserts):
        """From turn i on; ``inserts`` more in a row are allowed here."""
        found = [(0, "")] if i == len(initials) and last in ("", "a") else []
        if inserts:
            c, a = rest(i, "a" if last == "u" else "u", inserts - 1)
            found.append((c + 3, "I" + a))
        if i < len(initials):
            ways = [("", "D", 4)]
            if faults[i] not in "bd":
                ways += [(role, e, c + 3 * (faults[i] == "t")) for role, e, c in ((initials[i], "K", 0), ("u", "R", 3), ("a", "R", 3)) if (last, role) in STEPS]
            for role, e, cost in ways:
                c, a = rest(i + 1, role or last, 4)
                found.append((c + cost, e + a))
        return min(found, default=(10**9, ""))

    return rest(0, "", 4)


def test_viterbi_matches_search():
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randrange(8)
        initials = "".join(rng.choice("suao") for _ in range(n))
        faults = "".join(rng.choice("---tbd") for _ in range(n))
        got = turn_repair.viterbi(initials, faults)
        assert got == brute_repair(initials, faults), (initials, faults)
        roles = "".join(g[0] if e in "RI" else initials[i] for e, i, g in turn_repair.follow(initials, got[1]) if e != "D")
        assert GRAMMAR.fullmatch(roles)


def test_viterbi_of_a_long_conversation():
    rng = random.Random(6)
    initials = "".join(rng.choice("uuaas") for _ in range(20_000))
    faults = "".join(rng.choice("------tbd") for _ in range(20_000))
    cost, audit = turn_repair.viterbi(initials, faults)
    assert sum(e != "I" for e in audit) == 20_000 and 0 < cost < 60_000
    # the same through pieces
    told = turn_repair._pieces_of([0, 4096, 9000], [initials[:4096], initials[4096:9000], initials[9000:]], audit)
    assert "".join(p["audit"] for p in told) == audit
    spread = [e for p in told for e in p["audit"]]
    assert len(spread) == len(audit) and told[1]["place"] == sum(e != "D" for e in told[0]["audit"])


def brute_conversation(rows):
    """The contract's columns for the damaged rows (turn, role, text) of one conversation, in order."""
    turns = [t for t, _, _ in rows if t is not None]
    out = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0}
    seen, faults = set(), ""
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        faults += "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
    first = [r[:1] for _, r, _ in rows]
    out |= {"blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))}
    initials = "".join(x if x in ("s", "u", "a") else "o" for x in first)
    out["cost"], out["audit"] = brute_repair(initials, faults)
    lines, state = [], ""
    at = 0
    for e in out["audit"]:
        if e == "D":
            at += 1
            continue
        role = {"": "user", "s": "user", "a": "user", "u": "assistant"}[state]
        text = ""
        if e != "I":
            _, own, text = rows[at]
            role, at = (own if e == "K" else role), at + 1
        lines.append(f"{role}:{text}")
        state = role[0]
    out["repaired_sha256"] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return out


def brute_damage(rows):
    """rows of (conv, turn, role, text) to the damaged rows by conversation."""
    out = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = r if r is not None else " ", x if x is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out[c] += [(t, "user" if kind == 4 else r, x)] * (kind != 0) * (1 + (kind == 3))
    return {c: sorted(x, key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode())) for c, x in out.items()}


def test_repair_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: brute_conversation(x) for c, x in brute_damage(rows).items()}
    got = {r["conv_id"]: r.asDict() for r in queries()["op11_turn_repair_viterbi"](spark, SF).collect()}
    assert {c: {k: v for k, v in r.items() if k != "conv_id"} for c, r in got.items()} == want


def test_repair_of_odd_tables(spark, tmp_path):
    rng = random.Random(7)
    pool = [None, "", " \n", "Yes.", "No", "Why?", "x ", "Fine! ", "long " * 20_000]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 0, 1, 2, 5, 9]), rng.choice([None, "", "user", "assistant", "system", "tool"]), rng.choice(pool), "at", "piece") for _ in range(120)]
    rows += [(8, None, "user", None, "", ""), (9, None, None, "Hi.", "", "")] + [(10, 0, "user", "Same.", "", "")] * 6000
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string, edit string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: brute_conversation(x) for c, x in brute_damage([r[:4] for r in rows]).items() if c != 10}
    got = {r["conv_id"]: r.asDict() for r in queries()["op11_turn_repair_viterbi"](spark, str(tmp_path)).collect()}
    assert {c: {k: v for k, v in r.items() if k != "conv_id"} for c, r in got.items() if c != 10} == want
    assert got[10]["duplicate"] in (5999, 11999) and got[10]["audit"].count("D") == got[10]["duplicate"]
    report, repaired = turn_repair.repair(table.limit(0))
    assert report.count() == repaired.count() == 0


def test_damage_keeps_every_fault_apart(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in range(20)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in damaged(table).collect())
    assert got == sorted((c, *x) for c, xs in brute_damage(rows).items() for x in xs)


# Runs


def brute_runs(words, least=12):
    found = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, length, p) for (s, length), p in found.items())


def brute_collapse(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_arrays_match_brute_force():
    rng = random.Random(8)
    for trial in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            text = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(40))]
            for _ in range(rng.randrange(3)):
                text += text[-rng.randrange(1, 15) :] * rng.randrange(1, 6) + [rng.randrange(40)] * rng.randrange(3)
            texts.append(text[:300])
        lengths = np.array([len(t) for t in texts])
        flat = np.array([w for t in texts for w in t], np.int64)
        got = [tuple(r) for r in periodic.maximal_runs(flat, lengths, 12).tolist()]
        assert got == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t)], trial


def test_suffix_array_and_lcp():
    rng = random.Random(9)
    for _ in range(20):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(4)]
        flat = [(k, w) for k, t in enumerate(texts) for w in t]
        ids = np.unique([k * 10 + w for k, w in flat], return_inverse=True)[1].astype(np.int32)
        ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        rank, lcp = periodic.suffix_array(ids, ends)
        suffixes = [ids[i : ends[i]].tolist() for i in range(len(ids))]
        order = sorted(range(len(ids)), key=suffixes.__getitem__)
        assert rank[order].tolist() == list(range(len(ids)))
        for a, b, got in zip(order, order[1:], lcp[1:].tolist()):
            same = 0
            while same < min(len(suffixes[a]), len(suffixes[b])) and suffixes[a][same] == suffixes[b][same]:
                same += 1
            assert got == same


def brute_run_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    new = planted(doc_id, len(words)) if doc_id is not None and words else None
    words = words if new is None else [words[i] for i in new]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(brute_collapse(words, runs)))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(brute_run_row(r["doc_id"], r["text"]) for r in rows)
    assert sorted(tuple(r[c] for c in RUN_COLUMNS) for r in queries()["op12_periodic_runs"](spark, SF).collect()) == want


def test_runs_of_odd_texts(spark, tmp_path):
    texts = [None, "", " \n\t", "one", "a b " * 6, "a b " * 5 + "a", "w " * 11, "w " * 12, "w " * 3000, "x y z " * 400 + "q " + "x y z " * 400, "a\x00b é f " * 7, "same " * 20, "same " * 20]
    ids = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11]
    table = docs(spark, texts, ids)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = sorted((tuple(r[c] for c in RUN_COLUMNS) for r in queries()["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((brute_run_row(i, t) for i, t in zip(ids, texts)), key=key)
    assert periodic.periodic_runs(table.limit(0)).count() == 0
    whole = {r["doc_id"]: r for r in periodic.periodic_runs(table).collect()}
    assert whole[8]["collapsed"] == "w" and [tuple(r) for r in whole[8]["runs"]] == [(0, 3000, 1)] and whole[None]["runs"] == []


# Sets


def brute_set(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_jaccard(rows):
    """(doc_id, n_shingles, component) by comparing all pairs."""
    sets = {i: brute_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * (both := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(n)]


def copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = words(rng, rng.randrange(2))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most_rows", [4096, 6])
def test_jaccard_join_matches_brute_force(spark, most_rows):
    rng = random.Random(10)
    texts = []
    for size in (6, 7, 9, 12, 20, 40, 80, 150, 400):
        texts += copies(rng, words(rng, size), 14, max(1, size // 20))
    passage = words(rng, 40)
    texts += [" ".join(words(rng, 12) + passage + words(rng, 9)) for _ in range(20)]
    texts += ["one", "ONE", "one two", "one two three four five", "one two three four five six", "", None]
    rows = list(enumerate(texts))
    got = parity.jaccard_components(docs(spark, texts), most_rows=most_rows).collect()
    assert sorted(tuple(r) for r in got) == brute_jaccard(rows)


def test_jaccard_query_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries()["op13_jaccard_parity_join"](spark, SF).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_jaccard(rows)


def test_jaccard_of_odd_tables(spark):
    rng = random.Random(11)
    base = words(rng, 60)
    near = base[:30] + ["new"] + base[31:]
    texts = [" ".join(base), " ".join(base), " ".join(near), " ".join(words(rng, 50)), " ".join(base).upper(), None, "", "x " * 30_000]
    ids = [5, 5, None, 5, 3, 7, 8, 9]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in parity.jaccard_components(docs(spark, texts, ids)).collect()), key=str)
    n = len(brute_set(texts[0]))
    want = [(False, 5, n, 3), (False, 5, n, 3), (True, 0, len(brute_set(texts[2])), None), (False, 5, len(brute_set(texts[3])), 3), (False, 3, n, 3), (False, 7, 0, 7), (False, 8, 0, 8), (False, 9, 1, 9)]
    assert got == sorted(want, key=str)
    assert parity.jaccard_components(docs(spark, texts).limit(0)).count() == 0


def test_blocks_lose_no_linked_pair():
    rng, share = random.Random(12), Fraction(4, 5)
    for _ in range(300):
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.choice([4, 5, 6, 9, 10, 18, 27, 45, 90, 300]))], np.uint64))
        gone, new = rng.randrange(len(a) // 5 + 1), rng.randrange(len(a) // 5 + 1)
        b = np.unique(np.concatenate((a[rng.sample(range(len(a)), len(a) - gone)], np.array([rng.getrandbits(64) for _ in range(new)], np.uint64))))
        both = len(np.intersect1d(a, b))
        apart = len(a) + len(b) - 2 * both
        assert parity.differ(parity.sketch(a), parity.sketch(b)) <= apart
        if 5 * both >= 4 * (len(a) + len(b) - both) and apart:
            of, key = parity.block_keys(np.concatenate((a, b)), np.array([len(a), len(b)]), share)
            assert np.intersect1d(key[of == 0], key[of == 1]).size


def test_members_stream_over_batches():
    import pyarrow as pa

    rng = random.Random(13)
    for _ in range(50):
        key = np.sort(np.array([rng.randrange(8) for _ in range(rng.randrange(1, 25))]))
        ids = np.arange(len(key)) + 100
        cuts = sorted({0, len(key), *(rng.randrange(len(key) + 1) for _ in range(5))})
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(ids[a:b]), pa.array(ids[a:b].astype(np.int32))], names=["key", "id", "n"]) for a, b in zip(cuts, cuts[1:])]
        got = [tuple(r.values()) for out in parity._met(iter(batches)) for r in out.to_pylist()]
        first = {k: i for k, i in zip(key[::-1].tolist(), ids[::-1].tolist())}
        assert got == [(k, i, i, first[k]) for k, i in zip(key.tolist(), ids.tolist()) if (key == k).sum() > 1]


@pytest.mark.parametrize("small", [64, 3])
def test_cross_pairs_of_cells_over_batches(small):
    import pyarrow as pa

    rng, share = random.Random(14), Fraction(4, 5)
    for trial in range(30):
        base = [np.array([rng.getrandbits(64) for _ in range(rng.choice([20, 30]))], np.uint64) for _ in range(3)]
        sets = {}
        for k in range(14):
            own = rng.choice(base)
            sets[k] = np.unique(np.concatenate((own[: len(own) - rng.randrange(6)], np.array([rng.getrandbits(64) for _ in range(rng.randrange(4))], np.uint64))))
        rows = sorted((cell, rng.choice([0, 0, 1, 2]) if cell == 3 else 0, k, len(sets[k]), rng.randrange(5), parity.sketch(sets[k])) for cell in range(6) for k in rng.sample(range(14), rng.randrange(1, 9)))
        rows.sort(key=lambda r: r[0])
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(4))})
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a:b]), types)], names=list("abcdef")) for a, b in zip(cuts, cuts[1:])]
        got = {tuple(sorted(r.values())) for out in parity._cross_pairs(share, 4, small)(iter(batches)) for r in out.to_pylist()}
        want = set()
        for x in rows:
            for y in rows:
                if x[0] == y[0] and x[2] < y[2] and x[4] != y[4] and (x[1] != y[1] or x[1] == 0) and 5 * min(x[3], y[3]) >= 4 * max(x[3], y[3]):
                    if parity.differ(x[5], y[5]) <= (x[3] + y[3]) // 9:
                        want.add((x[2], y[2]))
        assert got == want, trial
