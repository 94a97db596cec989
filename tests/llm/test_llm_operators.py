"""The corpus operators against brute force, exact round trips and edge cases."""

import base64
import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clickloom.llm import chat, html_extract, language_id, mixing, quality_rules, simhash, token_store, toxic_crf, warc_zip, winnowing
from clickloom.llm.queries import default_tokenizer, oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hit_spans string, fp string"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, langs=None, sources=None, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", "  \n ", "one", "same text here", "same text here", "w " * 30_000]


# HTML

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav>
<div class="post-12 content"><h1>Head &amp; line</h1><p>First   paragraph
that is long enough to count as running text.<p>Second one<br>broken.</p><div class="comments"><p>Reader says hello to everyone here.</p></div></div>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_html_blocks_and_boilerplate():
    assert html_extract.page_text(PAGE, None) == "Head & line\n\nFirst paragraph that is long enough to count as running text.\n\nSecond one broken."


RUNNING = "Running text that is long enough to count, with more of it. " * 3


def in_site(inner):
    return html_extract.page_text(f"<html><body><div class='site'>{inner}</div></body></html>", None)


@pytest.mark.parametrize("name", "main-nav main-navigation sidebar-content entry-footer post-comments comment-body content-ad text-ad promo-text story-alert siteFooter cookieBanner navContent".split())
def test_html_frame_names_are_told_whatever_else_they_say(name):
    got = in_site(f"<div class='content'><h1>Head</h1><p>{RUNNING}</p><div class='{name}'><p>BAD {RUNNING}</p></div><p>End.</p></div>")
    assert got == f"Head\n\n{RUNNING.strip()}\n\nEnd."


@pytest.mark.parametrize(
    "inner",
    [
        f"<article><header><h1>Head</h1></header><p>{RUNNING}</p></article>",
        f"<article><h1>Head</h1><p class=side>{RUNNING}</p></article>",
        f"<article><h1>Head</h1><p class='share foot'>{RUNNING}</p></article>",
        f"<div class='content has-sidebar comments-open'><h1>Head</h1><p>{RUNNING}</p></div>",
        f"<form id=page><div><h1>Head</h1><p>{RUNNING}</p></div></form>",
        f"<div class='sidebar-layout'><div><h1>Head</h1><p>{RUNNING}</p></div><div class=sidebar>No</div></div>",
        f"<header><p>Site</p></header><div class=post><div class=entry-header><h1>Head</h1></div><p>{RUNNING}</p></div>",
        f"<article><h1>Head</h1><p>{RUNNING}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></article>",
        f"<article><h1>Head</h1><p>{RUNNING}</p></article><article class=comment><p>{RUNNING}</p><p>{RUNNING}</p></article>",
    ],
)
def test_html_articles_keep_what_is_theirs(inner):
    assert in_site(inner) == f"Head\n\n{RUNNING.strip()}"


def test_html_references_are_decoded_within_one_piece_of_text():
    assert in_site("<article><p>&<b>lt;</b> &amp; &lt;p&gt; &am<!-- x -->p; &#233;</p></article>") == "&lt; & <p> &amp; é"


def test_html_deep_and_long_pages():
    assert html_extract.page_text("<div class=a>" * 50_000 + "deep text" + "</div>" * 50_000, None) == "deep text"
    assert len(html_extract.page_votes("<div class=a>" * 50_000 + "deep text")[0]) < 20
    assert html_extract.page_text("<div>" * 20_000 + "</b></p></li>" * 20_000 + "x", None) == "x"
    long = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(30_000)) + "</article>"
    assert html_extract.page_text(long, None).count("\n\n") == 29_999


def test_html_texts_of_the_site_are_told_by_the_host(spark):
    page = "<html><body><div><h1>Title {i}</h1><p>" + RUNNING + " {i}</p><p class=x>" + RUNNING + " {i}</p><div class=tagline>Best in town.</div></div></body></html>"
    rows = [(i, f"https://a.example/{i}", page.format(i=i), "x", "y") for i in range(5)] + [(9, "https://b.example/", page.format(i=9), "x", "y")] * 5
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string")
    got = html_extract.extract(table).collect()
    assert len(got) == 10 and all("Best" not in r["text"] and r["text"].startswith("Title") for r in got if r["page_id"] < 9)
    assert all("Best" in r["text"] for r in got if r["page_id"] == 9)  # copies of one page tell nothing


def test_html_host_vote_beats_an_odd_page(spark):
    odd = "<body><div class='post-7 content'><p>Short.</p></div><div class='offers'><p>" + "Very long offer text. " * 40 + "</p></div></body>"
    rows = [(i, f"https://h.example/{i}", PAGE.replace("post-12", f"post-{i}")) for i in range(6)] + [(9, "https://h.example/9", odd), (10, None, None), (11, "nohost", ""), (12, "https://h.example/x", "<nav>only</nav>")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9]["text"] == "Short."
    assert got[10]["text"] == got[11]["text"] == got[12]["text"] == "" and got[10]["n_chars"] == 0
    assert len(got) == 10


def test_html_articles_of_the_fixture_are_whole(spark):
    for r in queries()["op1_html_consensus_paths"](spark, SF).collect():
        assert r["n_chars"] == len(r["text"]) > 0 and "<" not in r["text"].split("\n\n")[0]


def test_html_empty_table(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Quality


def brute_repeats(words, width=8):
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(width)})


def test_quality_counts_match_brute_force():
    rng = random.Random(1)
    for n in (0, 5, 8, 9, 16, 40, 300):
        words = [rng.choice(["a", "bb", "cé", "d#"]) for _ in range(n)] + (["x"] * 9 if n == 16 else [])
        text = "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
        got = quality_rules.text_signals(text.encode())
        lines = [x for x in text.split("\n") if x.strip()]
        assert got[:5] == (len(words), sum(map(len, words)), text.count("#"), len(lines) - len(set(lines)), brute_repeats(words))


def test_quality_verdicts(spark):
    good = [" ".join(f"word{(i * 7 + k * 13) % 97} of the line." if k % 9 == 0 else f"term{(i * 31 + k * k) % 389}"[:4] + "abcdefgh"[k % 5 :] for k in range(120)) for i in range(60)]
    bad = [" ".join(f"w{i}{k}###" for k in range(90)) for i in range(8)]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, good + bad + EDGES)).collect()}
    assert all(not got[60 + i]["kept"] for i in range(8))
    assert got[68]["n_words"] == 0 and got[68]["base_failed"] and not got[68]["kept"]
    assert got[74]["base_failed"] and got[74]["n_repeat_words"] == 30_000
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_label_model_recovers_known_accuracies():
    rng = np.random.default_rng(3)
    n, on_good, on_bad, speaks = 200_000, np.array([0.99, 0.97, 0.95, 0.98]), np.array([0.9, 0.6, 0.8, 0.4]), np.array([1, 0.9, 0.7, 0.8])
    good = rng.random(n) < 0.8
    right = rng.random((n, 4)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((n, 4)) < speaks)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit_label_model(patterns.astype(float), counts.astype(float), list("abcd"), rounds=2000)
    assert abs(model.prior - 0.8) < 0.02
    assert np.allclose(list(model.on_good.values()), on_good, atol=0.01) and np.allclose(list(model.on_bad.values()), on_bad, atol=0.05)


def test_quality_of_repeats_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = quality_rules.judge(docs(spark, [text, text, text], ids=[None, 4, 4])).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["4", "4", "None"] and len({(r["kept"], r["posterior"]) for r in rows}) == 1


def test_quality_agrees_with_labels(spark):
    got = queries()["op2_quality_weak_supervision"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed")
    row = got.agg(F.avg(F.expr("double(kept = (quality = 1))")).alias("right")).first()
    assert row["right"] > 0.95


# SimHash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    up = dict(prints)
    comp = {i: i for i in up}
    changed = True
    while changed:
        changed = False
        for i in up:
            for j in up:
                if (up[i] ^ up[j]).bit_count() <= radius and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 40, 200]))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(4):
            w = list(b)
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
            texts.append(" ".join(w))
    texts += [t for t in EDGES if not t or len(t) < 100]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    want = brute_components(prints)
    assert {i: (f"{p:016x}", want[i]) for i, p in prints.items()} == {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()}
    kept = {r["doc_id"] for r in simhash.deduplicate(docs(spark, texts)).collect()}
    assert kept == set(want.values())


def test_simhash_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for s in seeds]))
    a, b = simhash.tile_links(prints, np.zeros(len(prints), np.int8), 4, 16)
    forest = simhash._Forest(len(prints))
    forest.link(a, b)
    near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    assert all(forest.root(i) == forest.root(j) for i, j in near.tolist())


def test_simhash_hot_groups_are_cut_into_cells(spark):
    rng = random.Random(8)
    prints = sorted({(1 << 40) ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)) for _ in range(600)})
    reps = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, id long")
    found = simhash.links(reps, len(prints), radius=4, group_rows=8, most_rows=20).collect()
    forest = simhash._Forest(len(prints))
    forest.link(np.array([r["u"] for r in found]), np.array([r["v"] for r in found]))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 4:
                assert forest.root(i) == forest.root(j)


def test_simhash_keys_lose_no_link_at_any_size():
    rng = random.Random(2)
    for n in (10, 5_000, 10**7, 10**10, 10**12):
        keys = simhash.key_plan(n, 4, 1024)
        for _ in range(300):
            flips = [rng.randrange(64) for _ in range(4)]
            x = sum({1 << f for f in flips})
            assert any(all(not (x >> a) & ((1 << b) - 1) for a, b in pieces) for pieces in keys)
        assert n <= 1024 or 2 ** min(sum(b for _, b in k) for k in keys) * 1024 >= n


@pytest.mark.parametrize("group_rows", [1, 4])
def test_simhash_links_by_longer_keys(spark, group_rows):
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(300)]
    prints = sorted({b ^ sum({1 << rng.randrange(63) for _ in range(rng.randrange(5))}) for b in base for _ in range(3)})
    reps = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, id long")
    found = simhash.links(reps, len(prints) << 14, radius=4, group_rows=group_rows).collect()
    forest = simhash._Forest(len(prints))
    forest.link(np.array([r["u"] for r in found]), np.array([r["v"] for r in found]))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 4:
                assert forest.root(i) == forest.root(j)


def test_simhash_long_texts_and_repeated_ids(spark):
    texts = ["w " * 30_000, "w " * 30_001, "a b c d e", "a b c d e", "z y x w v"]
    table = docs(spark, texts, ids=[5, 6, 3, 3, 3], langs=["en", "en", "fr", "de", "de"])
    got = simhash.near_duplicates(table).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["doc_id"] > 3} == {5}
    for table in (table, table.repartition(3)):
        kept = simhash.deduplicate(table)
        assert kept.columns == table.columns
        assert sorted((r["doc_id"], r["lang"], r["text"][:1]) for r in kept.collect()) == [(3, "de", "a"), (5, "en", "w")]


def test_simhash_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.deduplicate(docs(spark, ["a b c d e", "a b c d e"], ids=[None, 4])).count() == 2


# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    rows = [(5, "http://a/ b\r\nX: y", "<p>é</p>", "x"), (3, None, "<p>é</p>", "x"), (9, "u", None, "x"), (8, "u", "", "x"), (1, "u", "q" * 3_000_000, "x"), (3, None, "<p>é</p>", "x")]
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc_zip.archive(pages(spark, rows)).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert got == {(5, "revisit", 3, 9, digest("<p>é</p>")), (3, "response", None, 9, digest("<p>é</p>")), (9, "revisit", 8, 0, digest("")), (8, "response", None, 0, digest("")), (1, "response", None, 3_000_000, digest("q" * 3_000_000))}
    assert warc_zip.archive(pages(spark, rows)).count() == 6
    assert warc_zip.archive(pages(spark, [])).count() == 0


def test_warc_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "ab", "x"), (2, "u", "ab", "x"), (3, "u", "abcdef", "x"), (4, "u", "abcdef", "x")]
    got = {r["page_id"]: r["record_type"] for r in warc_zip.archive(pages(spark, rows), least_bytes=4).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def _package():
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = member.compress(warc_zip.make_record(7, "u", b"body", "D", None, False, "2024-01-01T00:00:00Z")) + member.flush()
    return warc_zip.pack([(7, raw)])


def test_zip64_directory_is_read(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    content = _package()
    assert b"PK\6\6" in content and b"PK\6\7" in content
    for source in (warc_zip.BytesSource(content), warc_zip.FileSource(io.BytesIO(content))):
        package = warc_zip.Package(source)
        entry = next(package.entries())
        assert package.record(entry["offset"], entry["length"]).payload == b"body"


def test_compressed_members_and_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.ARCHIVE, b"x" * 100)
        z.writestr(warc_zip.INDEX, "")
        z.comment = b"a comment with PK\5\6 inside"
    assert set(warc_zip.members(warc_zip.BytesSource(out.getvalue()))) == {warc_zip.ARCHIVE, warc_zip.INDEX}
    with pytest.raises(ValueError, match="stored"):
        warc_zip.Package(warc_zip.BytesSource(out.getvalue()))
    with pytest.raises(ValueError):
        warc_zip.members(warc_zip.BytesSource(b"no zip"))


# Toxicity


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    model = toxic_crf.Field(moves=(-0.5, 0.7, -0.2, 1.1))
    counts = np.array([4, 0, 1, 3])
    scores = rng.normal(size=8)
    got = model.marginals(scores, counts)
    first, go, back, stay = model.moves
    at = 0
    for n in counts.tolist():
        total, hit = 0.0, np.zeros(n)
        for path in range(1 << n) if n else ():
            y = [path >> k & 1 for k in range(n)]
            e = y[0] * first + sum(y[k] * scores[at + k] for k in range(n))
            e += sum({(0, 1): go, (1, 0): back, (1, 1): stay}.get((a, b), 0.0) for a, b in zip(y, y[1:]))
            total += np.exp(e)
            hit += np.exp(e) * np.array(y)
        if n:
            assert np.allclose(got[at : at + n], hit / total)
        at += n


def test_toxicity_finds_spans_and_holds_out(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["sun", "tree", "river", "stone", "cloud"]) + rng.choice("abcdefgh") for _ in range(60)) for _ in range(400)]
    toxic = [" ".join(x if rng.random() > 0.08 else rng.choice(["Vilex", "vilor", "blarg"]) for x in t.split()) + " blarg" for t in clean[:120]]
    texts = clean + toxic + EDGES
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i >= 400)) for i in range(520)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxic_crf.score_toxicity(table, labels).collect()}
    held = [i for i in range(520) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(520))
    assert np.mean([got[i]["predicted"] == (i >= 400) for i in held]) > 0.97
    start, end = got[401]["spans"][0]
    assert texts[401][start:end].lower().split()[0] in ("vilex", "vilor", "blarg")
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(texts)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxic_crf.score_toxicity(docs(spark, EDGES), none).collect()
    assert {r["predicted"] for r in got} == {0} and len(got) == len(EDGES)


# Mixing


def test_mix_targets_and_caps(spark):
    rng = random.Random(6)
    texts = [" ".join("w" for _ in range(rng.randrange(1, 30))) for _ in range(600)]
    sources = [rng.choice(["a", "b", "b", "b", None, "c", "c"]) for _ in texts]
    got = mixing.mix(docs(spark, texts + [None, ""], sources=sources + ["a", None])).collect()
    again = mixing.mix(docs(spark, texts + [None, ""], sources=sources + ["a", None]).repartition(3)).collect()
    key = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert key(got) == key(again)
    size = {s: sum(r["size"] for r in got if r["source"] == s) for s in ("a", "b", "c", None)}
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    budget, target, open_ = 1.5 * sum(size.values()), {}, set(size)
    while open_:
        rest = budget - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} or {s: share[s] for s in open_}
        open_ = open_ - full if full else set()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
    for s in size:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 60
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mix_of_repeated_rows_is_divided(spark):
    table = docs(spark, ["one two three"] * 90 + ["four five six"] * 90, sources=["a"] * 90 + ["b"] * 90, ids=[1] * 90 + [2] * 90, langs=["en", "de"] * 90)
    got = mixing.mix(table).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n"), F.countDistinct("copies").alias("k")).collect()
    assert all(r["n"] == 90 and abs(r["taken"] - r["target"]) <= 3 and r["k"] <= 2 for r in got) and len(got) == 2
    mixed = [sorted((r["doc_id"], r["lang"]) for r in mixing.mixed_documents(t).collect()) for t in (table, table.repartition(5))]
    assert mixed[0] == mixed[1] and len(mixed[0]) * 3 == sum(r["taken"] for r in got)
    assert {x for _, x in mixed[0]} == {"en", "de"}


def test_mixed_documents_keep_clashing_columns(spark):
    table = docs(spark, [f"word{i} two" for i in range(20)], sources=[None] * 5 + ["b"] * 15).withColumns({"_h": F.lit(1), "copies": F.lit(2), "key": F.lit("k"), "size": F.lit(3), "h": F.lit("h")})
    rows = mixing.mixed_documents(table)
    assert rows.columns == table.columns and {(r["_h"], r["copies"], r["key"], r["size"], r["h"]) for r in rows.collect()} == {(1, 2, "k", 3, "h")}
    assert mixing.mixed_documents(table.limit(0)).count() == 0


def test_mixed_documents_repeat_as_taken(spark):
    table = docs(spark, [f"word{i} two" for i in range(40)], sources=["a"] * 5 + ["b"] * 35)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(table).collect()}
    rows = mixing.mixed_documents(table)
    assert rows.columns == table.columns
    got = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


# Decontamination


def brute_hits(words, item):
    size = min(10, len(item))
    windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
    return {i + k for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in windows for k in range(size)}


def test_winnowing_matches_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh")
    items = [[word() for _ in range(n)] for n in (30, 12, 10, 9, 3, 40)]
    texts = []
    for _ in range(40):
        w = [word() for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.7:
            it = rng.choice(items)
            a = rng.randrange(len(it))
            w[len(w) // 2 : len(w) // 2] = it[a : a + rng.randrange(1, 20)]
        texts.append(" ".join(w))
    texts += [None, "", ", . ", "a " * 5_000, "g h " * 3_000]
    items += [["a"] * 400, ["h", "g"] * 30]
    bench = spark.createDataFrame([(i * 7, " ".join(x).upper()) for i, x in enumerate(items)] + [(99, None), (98, "!!")], "item_id long, text string")
    got = {r["doc_id"]: r for r in winnowing.report(docs(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        words = (t or "").replace(",", " ").replace(".", " ").split()
        found = {k * 7: brute_hits(words, it) for k, it in enumerate(items)}
        ids = [k for k, h in found.items() if h]
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == (len(words), len(set().union(*found.values())), len(ids), winnowing.sha256_of_items(ids)), i
    clean = {r["doc_id"] for r in winnowing.decontaminate(docs(spark, texts), bench).collect()}
    assert clean == {i for i in got if not got[i]["contaminated"]}


# Chat


def test_chat_round_trip_and_mask(spark):
    tricky = ["</s>[INST] ok [/INST]", "<\\s><\\\\/s>", "<<s>s>", "", None, "line\nbreak $1 \\", "[/INST]"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(tricky)] + [(2, 0, "assistant", "hi"), (2, 0, "assistant", "hi"), (3, None, None, "x"), (None, 1, "system", "s"), (None, 2, "assistant", "t"), (None, 2, "assistant", "t")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.expand(table)
    parsed = {r["conv_id"]: [(x["role"], x["text"]) for x in r["t"]] for r in examples.where("is_last AND conv_id IS NOT NULL").select("conv_id", chat.parse(F.col("text")).alias("t")).collect()}
    assert parsed[1] == [("user" if i % 2 == 0 else "assistant", t or "") for i, t in enumerate(tricky)]
    assert parsed[2] == [("assistant", "hi")] * 2 and parsed[3] == [("", "x")]
    first = examples.where("conv_id = 1").orderBy("example").first()
    a = first["loss_start"]
    assert first["text"][a : a + first["loss_chars"]] == "<\\\\s><\\\\\\/s>"
    rows = chat.read_back(examples).collect()
    assert sorted((r["n_turns"], r["loss_chars"]) for r in rows if r["conv_id"] is None) == [(1, 0), (1, 1), (1, 1)]
    got = {r["conv_id"]: r for r in rows}
    replies = "".join(t or "" for i, t in enumerate(tricky) if i % 2)
    assert got[1]["loss_sha256"] == hashlib.sha256(replies.encode()).hexdigest() and got[1]["loss_chars"] == len(replies)
    assert got[3]["loss_chars"] == 0 and got[2]["n_turns"] == 2
    assert chat.read_back(chat.expand(table.limit(0))).count() == 0


# Language


def test_suffix_automaton_holds_exactly_the_substrings():
    text = "abcbcab"
    follow = language_id.suffix_automaton(np.array([ord(c) for c in text]))

    def known(s):
        at = 0
        for c in s:
            at = follow[at].get(ord(c), -1)
            if at < 0:
                return False
        return True

    words = ["".join(x) for n in range(1, 5) for x in __import__("itertools").product("abc", repeat=n)]
    assert all(known(w) == (w in text) for w in words)


SCRIPTS = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзийклмнопрстуфхцчшщ", "el": "αβγδεζηθικλμνξοπρστυ", "ka": "აბგდევზთიკლმნოპჟრსტ", "zh": "".join(chr(0x4E00 + i) for i in range(900))}


def _prose(lang, k, seed):
    rng = random.Random(sum(map(ord, lang)))
    words = ["".join(rng.choice(SCRIPTS[lang]) for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(k))


def brute_phrases(sample, codes):
    hay, text, n = "".join(map(chr, sample)), "".join(map(chr, codes)), 0
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in hay:
            j += 1
        i, n = j, n + 1
    return n


@pytest.mark.parametrize("how", [{}, {"rounds": 1}, {"chunk": 64, "most_lanes": 5, "at_once": 2}])
def test_phrases_are_those_of_one_greedy_parse(how):
    samples = {lang: _prose(lang, 800, 1) for lang in SCRIPTS}
    parser = language_id.Parser.fit(samples)
    texts = [_prose(lang, 1500, 2) for lang in SCRIPTS] + [_prose("en", 3, 3) + _prose("ru", 300, 4), "e e " * 800, "a" * 255, "b" * 256, "q" * 257, "", "Ж"]
    coded = [language_id.symbols(t, parser.letters) for t in texts]
    assert max(map(len, coded)) > 5000
    got = parser.phrases(coded, **how)
    for k, lang in enumerate(parser.languages):
        sample = language_id.symbols(samples[lang], parser.letters)[:24_000]
        assert [brute_phrases(sample, c) for c in coded] == got[:, k].tolist(), lang


def test_languages_of_several_scripts(spark):
    texts = [_prose(lang, 40, seed) for seed in range(30) for lang in SCRIPTS]
    rows = language_id.identify(docs(spark, texts, langs=list(SCRIPTS) * 30)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in rows} == dict(enumerate(list(SCRIPTS) * 30))


def test_language_held_out_accuracy_and_edges(spark):
    got = queries()["op9_language_cross_parsing"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg(F.expr("double(lang = lang_pred)"))).first()[0] > 0.98
    texts = ["ein haus und ein hund im wald"] * 30 + ["the house and the dog in wood"] * 30 + [None, "", "123 !", "½", "das haus", "das haus " * 30_000, "das haus"]
    ids = [*range(66), None]
    rows = {r["doc_id"]: r for r in language_id.identify(docs(spark, texts, langs=["de"] * 30 + ["en"] * 30 + [None] * 7, ids=ids)).collect()}
    assert [rows[i]["lang_pred"] for i in (60, 61, 62, 63, 64, 65, None)] == ["und"] * 4 + ["de"] * 3 and rows[None]["held_out"] is None
    assert language_id.identify(docs(spark, [])).count() == 0
    assert language_id.identify(docs(spark, ["das haus"] * 3, ids=[1, 1, 1])).count() == 3
    assert {r["lang_pred"] for r in language_id.identify(docs(spark, ["a b"], langs=[None])).collect()} == {"und"}
    assert language_id.Panel(docs(spark, ["a"] * 9, langs=list("abcdefghi")), at_once=2).n_groups in (4, 5)


def test_language_stage_writes_its_prediction_and_rejects(spark):
    texts = ["ein haus und ein hund im wald"] * 30 + ["the house and the dog in wood"] * 30 + [None, "", "123 !", "das haus und der hund", "ქართული ენა არის ლამაზი"]
    table = docs(spark, texts, langs=["de"] * 30 + ["en"] * 30 + [None] * 5)
    kept = language_id.with_language(table)
    assert kept.columns == table.columns
    assert {r["doc_id"]: r["lang"] for r in kept.collect()} == {i: "de" if i < 30 or i == 63 else "en" for i in (*range(60), 63)}
    bare = language_id.with_language(docs(spark, ["plain words", "other ones", "1 2"], langs=[None] * 3)).collect()
    assert {(r["doc_id"], r["lang"]) for r in bare} == {(0, None), (1, None)}
    assert language_id.with_language(docs(spark, [])).count() == 0


# Token ids


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["It's 12 cats…  and\n\n'tis ", "naïve Ünï <|endoftext|> x", "日本語 text", "a b   c", "", None, "same", "same", "x" * 5000 + " y" * 5000]
    ids = [9, 3, 5, 5, 2, None, 7, 7, 1]
    library = Tokenizer.from_file(default_tokenizer())
    want, start = [], 0
    hashes = {r["text"]: r["h"] for r in docs(spark, texts).select("text", F.xxhash64("text").alias("h")).collect()}
    for i, t in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]])):
        enc = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(enc), zlib.crc32(np.array(enc, "<u4").tobytes())))
        start += len(enc)
    for table in (docs(spark, texts, ids=ids), docs(spark, texts, ids=ids).repartition(5).withColumnRenamed("source", "digest")):
        got = [tuple(r) for r in token_store.tokenise(table, default_tokenizer()).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert token_store.tokenise(docs(spark, []), default_tokenizer()).count() == 0


def test_encoder_forgets_texts_that_go_to_the_library_whole():
    encoder = token_store.Encoder(default_tokenizer(), 2)
    text = "日本語の文 " * 50
    first = encoder.encode([text.encode(), b"plain"])[0]
    used = encoder.used
    for _ in range(5):
        assert encoder.encode([text.encode(), b"plain"])[0].tolist() == first.tolist()
    assert encoder.used == used


def test_token_file_reads_one_document_by_its_index():
    raw = [np.arange(k, k + 50, dtype="<u4").tobytes() for k in range(40)]
    shared = token_store.zstandard.train_dictionary(2048, raw * 20).as_bytes()
    compress = token_store.compressor(shared)
    content = token_store.pack([(k, 0, 50, zlib.crc32(x), compress(x)) for k, x in enumerate(raw)], hashlib.sha256(shared).digest())
    file = token_store.TokenFile(content, shared)
    assert file.find(17)[0].tolist() == list(range(17, 67)) and file.find(99) == []
    with pytest.raises(ValueError):
        token_store.TokenFile(content, b"")


# Queries and the pipeline


def test_queries_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        got, want = queries()[name](spark, SF), con.execute(sql)
        columns = sorted(c[0] for c in want.description)
        order = [[c[0] for c in want.description].index(c) for c in columns]
        assert sorted(got.columns) == columns
        plain = lambda r: tuple("-" if v is None else repr(v) for v in r)
        assert sorted(plain(r) for r in got.select(columns).collect()) == sorted(plain(r[i] for i in order) for r in want.fetchall()), name


def test_pipeline_stages_take_odd_tables(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs(spark, [None, "", "a b", "a b", "the house and the dog", "the house and the dog"], ids=[None, 1, 2, 2, 3, 4], langs=[None] * 6, sources=[None, "a", "a", "a", None, "b"]).select(table.columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), SF).count() == 0, name
        assert stage(spark, odd, SF).count() >= 2, name


def test_storage_of_a_scratch_is_deleted(spark):
    from clickloom.functions.storage import scratch
    from clickloom.llm.common import materialise

    with scratch():
        gone = materialise(spark.range(3), "gone")
        kept = materialise(spark.range(3), "kept", keep=True)
        assert gone.count() == 3
    assert kept.count() == 3
    with pytest.raises(Exception, match="exist|PATH_NOT_FOUND|FILE"):
        spark.read.parquet(gone.inputFiles()[0]).count()


def test_pipeline_matches_its_stages_by_hand(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in table.collect()}
    known = {r["doc_id"] for r in language_id.with_language(table).collect()}
    assert known == {i for i, r in rows.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    comp = brute_components({i: brute_print(rows[i]["text"]) for i in known})
    one = {i for i in known if comp[i] == i}
    items = [winnowing.words_of(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in one if not any(brute_hits(winnowing.words_of(rows[i]["text"].encode()), it) for it in items if it)}
    left = spark.createDataFrame([rows[i] for i in sorted(clean)], table.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(left).collect()}
    got = {r["doc_id"]: r["n"] for r in corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in copies.items() if n}


def test_field_reads_every_word_of_its_documents(spark):
    filler = [" ".join(f"w{k}x{i}" for i in range(120)) for k in range(1000)]
    pairs = [(filler[k] + f" vile late{k // 100} late{k // 100}", 1) for k in range(1000)] + [(f"plain text number {k} here", 0) for k in range(1000)]
    assert {"w=late0", "w=late9"} <= set(toxic_crf.train(pairs, rounds=2).weights)


def test_near_copies_are_told_by_their_whole_texts():
    start, other = np.arange(500), np.arange(1000, 1500)
    texts = [(np.append(start, 7001), 1), (np.append(start, 7002), 1), (np.append(start, other), 1), (np.append(start, 7001), 0), (start[:0], 0), (start[:2], 0), (start[:2], 0)]
    assert [id(x) for x, _ in toxic_crf.without_copies(texts)] == [id(texts[i][0]) for i in (0, 2, 3, 5)]


@pytest.mark.parametrize("cut", [1, 3, 256])
def test_chains_are_carried_over_lanes(monkeypatch, cut):
    rng = np.random.default_rng(7)
    model = toxic_crf.Field(moves=(-0.5, 0.7, -0.2, 1.1))
    counts = np.array([700, 0, 3, 256, 512, 257, 1])
    scores = rng.normal(size=int(counts.sum())) * 3
    monkeypatch.setattr(toxic_crf, "LANE", 10_000)
    want = model.marginals(scores, counts)
    monkeypatch.setattr(toxic_crf, "LANE", cut)
    assert np.allclose(model.marginals(scores, counts), want)


def test_training_documents_of_repeated_ids_are_the_least_text(spark):
    i = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 3 != 1)
    labels = spark.createDataFrame([(i, 1, 1), (i, 0, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, ["b text", "a text", None], ids=[i] * 3)
    assert toxic_crf.training_documents(table, labels) == [("a text", 1)]


def test_training_documents_come_in_hash_order(spark):
    table = docs(spark, [f"text {k}" for k in range(40)], ids=list(range(40)))
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    got = [int(text.split()[1]) for text, _ in toxic_crf.training_documents(table, labels)]
    want = [r["doc_id"] for r in table.where(F.col("doc_id").isin(got)).orderBy(F.xxhash64("doc_id", F.lit(5))).collect()]
    assert got == want != sorted(got)
