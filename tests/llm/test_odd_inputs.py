"""Nulls, repeats, ties, empty tables and clashing columns that no other test holds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clickloom.llm import chat, html_extract, mixing, quality_rules, token_store, toxic_crf, warc_zip, winnowing

CLASH = "doc_id long, text string, lang string, source string, n_chars long, told string, row string, bad string, taken string, size string, fp string, language string, score string, place string"


def docs(spark, rows):
    """(doc_id, text[, source]) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s[0] if s else "s", len(t or ""), *["x"] * 9) for i, t, *s in rows], CLASH)


def test_pages_that_are_repeated_or_have_no_id(spark):
    page = "<article><h1>Head</h1><p>Some words of the page.</p></article>"
    rows = [(1, "https://a.example/", page)] * 3 + [(None, "https://a.example/", page), (None, None, None), (2, "", "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == sorted((str(i), "Head\n\nSome words of the page." if h == page else h or "") for i, _, h in rows)


def test_a_posterior_at_the_threshold_keeps(spark):
    model = quality_rules.LabelModel(0.5, {"a": 0.9}, {"a": 0.9})
    row = spark.createDataFrame([(0,), (1,), (-1,)], "a int").select("a", model.posterior().alias("p")).collect()
    assert {r["a"]: r["p"] for r in row}[0] == 0.5 and [r["p"] > 0.5 for r in row] == [False, True, False]
    texts = [(i, " ".join(f"word{i}{k} of" for k in range(30)) + ".") for i in range(4)]
    table = docs(spark, texts)
    at = quality_rules.judge(table).select("posterior").first()["posterior"]
    assert all(r["kept"] for r in quality_rules.judge(table, threshold=at).collect())
    assert not any(r["kept"] for r in quality_rules.judge(table, threshold=math.nextafter(at, 2)).collect())


def test_records_of_pages_without_id(spark):
    rows = [(None, "u", "same"), (3, "u", "same"), (2, "u", "same"), (None, "u", "other"), (None, "u", "other"), (5, None, None), (4, "u", "")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_zip.archive(table).collect()), key=str)
    assert len(got) == 7
    assert (2, 4, "response", None) in got and (3, 4, "revisit", 2) in got and (4, 0, "response", None) in got and (5, 0, "revisit", 4) in got
    assert all(r[3] == 2 for r in got if r[0] is None and r[1] == 4)


def test_toxicity_of_rows_without_id_and_of_no_rows(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(i, f"plain words number {i} " + ("vile vile" if i % 2 else "kind kind")) for i in range(60)] + [(None, "vile vile words"), (None, None)]
    got = toxic_crf.score_toxicity(docs(spark, rows), labels).collect()
    assert len(got) == 62 and all(0 <= r["score"] <= 1 for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [None, None]
    assert toxic_crf.score_toxicity(docs(spark, []), labels).count() == 0


def test_mix_of_rows_without_id_and_of_long_texts(spark):
    rng = random.Random(5)
    rows = [(None if i % 7 == 0 else i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", None])) for i in range(150)] + [(999, "long " * 200_000, "c")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 151 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_windows_of_repeated_rows_and_of_no_benchmark(spark):
    item = " ".join(f"item{k}" for k in range(14))
    rows = [(1, f"before {item} after"), (1, f"before {item} after"), (None, item), (2, "nothing of it"), (None, None)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    table = docs(spark, rows)
    got = sorted((str(r["doc_id"]), r["n_hit"]) for r in winnowing.report(table, bench).collect())
    assert got == sorted([("1", 14), ("1", 14), ("None", 14), ("2", 0), ("None", 0)])
    left = winnowing.decontaminate(table, bench)
    assert left.columns == table.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "None"]
    assert winnowing.report(table, bench.limit(0)).where("n_hit > 0").count() == 0 and winnowing.decontaminate(table, bench.limit(0)).count() == 5


def test_words_and_pieces_of_any_length_are_bounded():
    memo = winnowing.WordHashes()
    memo.seeds([bytes([65 + k % 26]) * 20_000 + str(k).encode() for k in range(300)])
    assert sum(map(len, memo)) < 1000
    memo.seeds([b"short", b"words"])
    assert len(memo) == 2


def test_encoder_forgets_by_the_characters_it_holds():
    from clickloom.llm.queries import default_tokenizer

    encoder = token_store.Encoder(default_tokenizer(), 2, most_chars=50_000)
    first, n = encoder.encode([b"some plain text"])
    for k in range(8):
        encoder.encode([("x" * 20_000 + str(k)).encode()])
        assert encoder.chars <= 90_000
    assert encoder.encode([b"some plain text"])[0].tolist() == first.tolist()


def test_long_conversations_and_clashing_columns(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} </s>", "x", 5) for t in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string, loss_start long")
    got = chat.read_back(chat.expand(table)).collect()
    assert len(got) == 1 and got[0]["n_turns"] == 300 and got[0]["n_examples"] == 150 and got[0]["loss_chars"] == sum(len(r[3]) for r in rows[1::2])


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_clashing_columns(spark, k):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumns({c: F.lit("x") for c in ("told", "row", "bad", "taken", "size", "fp", "language", "score", "place", "copies", "key", "h")})
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, table, sf)
    assert got.columns == table.columns and {r["row"] for r in got.collect()} == {"x"}, name


def test_folders_of_components_are_deleted(spark):
    from pathlib import Path

    from clickloom.functions.storage import scratch, shared_dir
    from clickloom.llm.components import components

    root = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in root.rglob("*") if p.is_dir()}
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with scratch():
        assert components(edges).where("component = 0").count() == 60
        assert len([p for p in (root / "clickloom").iterdir() if p.name.startswith("components-") and p.name not in before]) == 1
    assert not [p for p in (root / "clickloom").iterdir() if p.name.startswith("components-") and p.name not in before]


def test_toxicity_score_is_that_of_all_taggings(spark):
    import itertools

    model = toxic_crf.Field({"w=vile": 2.0, "w=foul": 1.0, "w=so": 0.3}, -1.0, (-0.5, 0.4, -0.2, 0.6), (-3.0, 2.0, 1.5, 0.7))
    texts = ["vile so foul", "so so", "foul vile vile and so", "nothing here at all", ""]
    got = {r["doc_id"]: r for r in toxic_crf.tag(docs(spark, list(enumerate(texts))), model).collect()}
    first, go, back, stay = model.moves
    for i, t in enumerate(texts):
        emit = [-1.0 + model.weights.get(f"w={w}", 0.0) for w in t.split()]
        whole, on = 0.0, [0.0] * len(emit)
        for tags in itertools.product((0, 1), repeat=len(emit)):
            steps = sum({(0, 0): 0.0, (0, 1): go, (1, 0): back, (1, 1): stay}[x] for x in zip(tags, tags[1:]))
            e = math.exp(sum(a for a, on_ in zip(emit, tags) if on_) + (first if tags and tags[0] else 0.0) + steps)
            whole += e
            on = [o + e * x for o, x in zip(on, tags)]
        p = [o / whole for o in on]
        facts = [1.0, math.log1p(sum(p)), max(p), math.sqrt(sum(p) / len(p))] if p else [1.0, 0.0, 0.0, 0.0]
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(facts, model.scale))))), t
