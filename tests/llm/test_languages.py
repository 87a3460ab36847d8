"""Languages: codewords, held-out accuracy, segments and labels."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from spanloom.llm import languages as L

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


@pytest.fixture(scope="module")
def samples(spark):
    if not os.path.exists(SAMPLES):
        pytest.skip("no labelled samples here")
    return [(r.lang, r.text) for r in spark.read.parquet(SAMPLES).orderBy("sample_id").collect()]


@pytest.fixture(scope="module")
def model(samples):
    return L.fit(samples[::2])


def test_codewords_are_far_apart():
    code = L.codewords(10)
    apart = (L.BITS - code @ code.T) / 2
    assert min(apart[i, j] for i in range(10) for j in range(i)) >= 5
    assert L.codewords(1).shape == (1, L.BITS)


def test_held_out_windows(model, samples):
    right = total = 0
    for lang, text in samples[1::2]:
        m = model.margins([L.bare(w) for w in text.split()])
        for a in range(0, len(m) - 14, 15):
            best, _ = model.decode(m[a : a + 15].mean(axis=0)[None])
            right, total = right + (model.langs[best[0]] == lang), total + 1
    assert right / total > 0.995


def test_segments_and_labels(spark, model, samples):
    by = {}
    for lang, text in samples[1::2]:
        by.setdefault(lang, []).extend(text.split())
    say = lambda lang, n, at=0: " ".join(by[lang][at : at + n])
    rows = [
        (1, say("en", 60), "en"), (2, say("en", 60), " EN_us "), (3, say("en", 60), "de"), (4, say("en", 60), None), (5, say("ru", 40) + "\n" + say("fr", 40), "ru"),
        (6, say("sv", 50) + " " + say("it", 6) + " " + say("sv", 50, 50), "Swedish"), (7, say("pl", 8), "en"), (8, None, "en"), (9, "", None), (10, "한국어 문장 " * 30, "en"),
        (11, "12 34 -- 56 " * 20, "en"), (12, say("nl", 30) + " " + say("de", 30) + " " + say("nl", 30, 40), "mul"), (13, say("pt", 30), "por-BR"), (14, say("es", 30), "xx"), (14, say("es", 30), "xx"),
    ]
    docs = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id bigint, text string, lang string, segment int, confidence string")
    got = sorted(map(tuple, L.wrong_labels(docs, model).collect()))
    assert got == [(3, "en"), (4, "en"), (5, "fr"), (5, "ru"), (12, "de"), (12, "nl"), (14, "es")]
    parts = L.language_segments(docs, model).where("doc_id = 5").orderBy("segment").collect()
    assert [p.lang for p in parts] == ["ru", "fr"] and sum(p.n_words for p in parts) == 80 and all(p.confidence > 0.9 for p in parts)
    assert L.language_segments(docs.limit(0), model).count() == 0


def test_stated(spark):
    given = {"en": "en", " EN-gb": "en", "English": "en", "dut": "nl", "nld_BE": "nl", "zh": None, "": None, "mul": None, "e n": None, "fre": "fr"}
    rows = spark.createDataFrame([(k,) for k in given], "l string").select("l", L.stated(F.col("l")).alias("s")).collect()
    assert {r.l: r.s for r in rows} == given


def test_numbers_and_foreign_scripts_take_no_part_in_a_stretch(spark, model, samples):
    by = {}
    for lang, text in samples[1::2]:
        by.setdefault(lang, []).extend(text.split())
    say = lambda lang, n: " ".join(by[lang][:n])
    rows = [
        (1, say("de", 22) + " 17" * 80, None),  # a stretch that long is one, whatever stands beside it
        (2, "17 " * 80 + say("fr", 22) + " 한국어" * 80, "xx"),
        (3, "4 5 6 " * 30 + say("it", 5) + " 7 8 9" * 30, None),  # numbers don't make a stretch of a quotation
        (4, say("es", 30) + " " + "x" * 100_000 + " " + say("es", 30), "en"),
    ]
    got = sorted(map(tuple, L.wrong_labels(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model).collect()))
    assert got == [(1, "de"), (2, "fr"), (4, "es")]
