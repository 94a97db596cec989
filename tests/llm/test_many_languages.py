"""Language ID with more languages than one group holds."""

import random

import pytest

from clickloom.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fits string"


def invented(rng, n):
    """Languages by their syllables."""
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x3B1, 0x3C9)] + [chr(c) for c in range(0x430, 0x450)]
    return {f"l{k:04d}": ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 4))) for _ in range(7)] for k in range(n)}


def sentence(rng, syllables, n=14):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


def table(spark, rng, languages, each):
    rows = [(i, sentence(rng, languages[name]), name) for i, name in enumerate(name for name in languages for _ in range(each))]
    odd = [(10**6, None, "l0000"), (10**6 + 1, "", None), (10**6 + 2, "12 34", None), (None, rows[0][1], None), (10**6 + 3, rows[1][1] * 400, None)]
    return spark.createDataFrame([(i, t, l, "s", 0, "x", "y") for i, t, l in rows + odd], SCHEMA)


def test_groups_tell_what_one_table_tells(spark):
    rng = random.Random(1)
    docs = table(spark, rng, invented(rng, 7), 9).cache()
    key = lambda r: (str(r["doc_id"]), r["lang_pred"])
    one, two = (sorted(language_id.identify(docs, at_once=n).collect(), key=key) for n in (64, 3))
    assert [key(r) for r in one] == [key(r) for r in two] and len(one) == docs.count()
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in two])
    a, b = (sorted(map(str, language_id.with_language(docs, at_once=n).collect())) for n in (64, 3))
    assert a == b and language_id.with_language(docs, at_once=3).columns == docs.columns
    assert language_id.identify(docs.limit(0), at_once=3).count() == 0


def test_two_thousand_languages(spark):
    rng = random.Random(2)
    docs = table(spark, rng, invented(rng, 2000), 3)
    got = [r for r in language_id.identify(docs, at_once=500, per_language=3).join(docs.select("doc_id", "lang"), "doc_id").collect() if r["lang"]]
    # a language of which no text was left to learn from cannot be told
    learned = {r["lang"] for r in docs.where("crc32(binary(string(doc_id))) % 4 <> 2 AND text IS NOT NULL").select("lang").distinct().collect()}
    held = [r for r in got if r["held_out"] and r["lang"] in learned]
    assert len(learned) > 1900 and len(held) > 1000
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.9 * len(held)
