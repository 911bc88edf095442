import zlib

import numpy as np
import pytest

from helpers import NASTY, frame
from quarrymill.llm import language, quality


def test_dual_descent_reaches_the_margin():
    rows = [np.array(r, np.int32) for r in ([0, 1], [0, 2], [3, 1], [3, 2])]
    w, b = quality._descend(rows, np.ones(4), np.array([1.0, 1, -1, -1]), np.full(4, 10.0), epochs=500)
    margins = [w[r].sum() + b for r in rows]
    assert margins[0] == pytest.approx(1, abs=0.02) and margins[3] == pytest.approx(-1, abs=0.02)


def test_quality_held_out(spark, sf):
    big = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = quality.op10(spark, big).collect()
    assert len(got) == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in tested]) > 0.97


def test_quality_nasty(spark):
    labels = spark.createDataFrame([(i, i % 2, 9) for i, _ in NASTY] + [(3, None, 9), (77, 1, 9), (4, 0, 1)], "doc_id long, quality int, text int")
    got = quality.score(frame(spark), labels).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in NASTY] and all(0 <= r.score <= 1 for r in got)
    assert quality.score(frame(spark, []), labels).count() == 0


def test_quality_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(frame(spark), empty).collect()} == {0.5}
    ones = spark.createDataFrame([(8, 1)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.score(frame(spark), ones).collect())


def test_same_texts_get_the_same(spark):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in NASTY], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(frame(spark), labels).collect()}
    assert got[5] == got[6] and got[1] == got[2] == got[16]


def test_language_held_out(spark, sf):
    big = sf.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").collect()}
    got = language.op8(spark, big).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.98
    assert np.mean([r.rejected for r in got]) < 0.002


def languages(spark, rows):
    return spark.createDataFrame([(i, t, lang, 3) for i, t, lang in rows], "doc_id long, text string, lang string, score int")


def test_language_nasty(spark):
    learn = [(i, f"the quick brown fox number jumps {'over ' * (i % 3)} dogs and cats", "en") for i in range(30)]
    learn += [(100 + i, f"der schnelle braune Fuchs springt {'über ' * (i % 3)} Hunde und Katzen", "de") for i in range(30)]
    learn += [(200, None, "xx"), (201, "no language", None), (202, "123", "digits"), (203, "", "empty")]
    model = language.learn(languages(spark, learn))
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language.identify(frame(spark, [*NASTY, (50, "brown dogs and cats"), (51, "Hunde springt über"), (52, "жук 漢字")]), model).collect()}
    assert got[50].lang_pred == "en" and got[51].lang_pred == "de" and not got[50].rejected and not got[51].rejected
    assert got[52].rejected and got[52].lang_pred in ("de", "en")
    for i in (1, 2, 3, 16, 18, 19):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[4].lang_pred != "und"
    assert language.identify(frame(spark, []), model).count() == 0


def test_nothing_to_learn(spark):
    model = language.learn(languages(spark, []))
    assert {r.lang_pred for r in language.identify(frame(spark), model).collect()} == {"und"}


def test_unlearned_latin_languages_are_rejected(sf):
    import pyarrow.parquet as pq

    by = {}
    for r in pq.read_table(f"{sf.replace('0.001', '0.1')}/documents.parquet", columns=["text", "lang"]).to_pylist():
        if r["lang"] and language.has_letter(r["text"]):
            by.setdefault(r["lang"], []).append(r["text"])
    model = language.Centroids([(lang, *language.counts(t)) for lang, rows in by.items() for t in rows[:400]])
    r = np.random.default_rng(3)
    strange = [
        "De kinderen spelen in het park terwijl hun ouders koffie drinken en over het weer praten.",
        "I bambini giocano nel parco mentre i genitori bevono il caffè e parlano del tempo.",
        "Dzieci bawią się w parku, a ich rodzice piją kawę i rozmawiają o pogodzie.",
        "Lapset leikkivät puistossa, kun heidän vanhempansa juovat kahvia ja puhuvat säästä.",
        "Çocuklar parkta oynarken anne babaları kahve içiyor ve hava hakkında konuşuyor.",
        " ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(3, 10))) for _ in range(60)),
    ]
    assert [x[2] for x in model.classify(strange)] == [True] * len(strange)
    for rows in by.values():
        assert np.mean([x[2] for x in model.classify(rows[400:900])]) <= 0.015
