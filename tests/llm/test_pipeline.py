import random
from collections import defaultdict

import corpus_pipeline
from helpers import NASTY
from test_personal_data import brute
from test_simhash import brute_similar
from test_tokens import check_pieces

from quarrymill.llm import personal_data as pd

WORDS = {"en": "the of and to in that is was for with river stone".split(), "de": "der die und in den von zu das mit sich Straße Haus".split()}


def rows():
    r = random.Random(4)
    out = []
    for i in range(90):
        lang = r.choice(["en", "de"])
        out.append((1000 + i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(20, 120))) + r.choice(["", " mail a.b@c.de now"]), lang))
    out += [(3000 + i, out[i][1], out[i][2]) for i in range(30)] + [(5000, out[0][1] + ".", "en"), (5001, None, "en"), (5001, None, "en"), (5002, "123", None), (5003, out[3][1], None), (5003, out[3][1], None)]
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "src", len(t or ""), "kept", 3) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long, block string, digest int").repartition(3)


def brute_stages(docs, known):
    docs = [d for d in docs if d[0] in known]
    groups = defaultdict(list)
    for i, t, _ in docs:
        groups[t].append(i)
    kept = sorted({max(g): t for t, g in groups.items()}.items())
    yield kept
    component = brute_similar(kept)
    kept = [(i, t) for i, t in kept if component[i] == i]
    yield kept

    def redact(text):
        out, at = "", 0
        for a, k, b in brute(text):
            if a >= at:
                out += text[at:a] + f"[{pd.KINDS[k].upper()}]"
            at = max(at, b)
        return out + text[at:]

    yield [(i, redact(t)) for i, t in kept]


def walk(spark, df):
    made = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, df, "")
        assert new.columns == df.columns and [f.dataType for f in new.schema] == [f.dataType for f in df.schema]
        df = corpus_pipeline.materialize(new, "test")
        made.append(df.collect())
    return made, corpus_pipeline.STAGES[-1][1](spark, df, "").collect()


def test_stages_like_brute_force(spark):
    docs = rows()
    made, pieces = walk(spark, frame(spark, docs))
    known = {r.doc_id for r in made[0]}
    assert known == {i for i, _, _ in docs} - {5001, 5002}
    for got, want in zip(made[1:], brute_stages(docs, known), strict=True):
        assert sorted((r.doc_id, r.text) for r in got) == want
        assert all(r.source == "src" and r.block == "kept" and r.n_chars == len(r.text) for r in got)
    check_pieces(pieces, [(r.doc_id, r.text) for r in made[-1]])


def test_exact_copies_of_repeated_ids(spark):
    docs = [(5, "A text", "en"), (9, "A text", "en"), (5, "B other", "en"), (7, "C", "en"), (7, "C", "de"), (7, "C", "de"), (8, None, "en"), (9, "", "fr")]
    got = corpus_pipeline.exact_copies(spark, frame(spark, docs), "").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == [(5, "B other", "en"), (7, "C", "de"), (9, "", "fr"), (9, "A text", "en")]


def test_near_copies_of_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = [(5, "quite another text", "en"), (5, text + " end", "en"), (3, text, "en"), (9, text + " x", "en"), (9, "own words", "en")]
    got = corpus_pipeline.near_copies(spark, frame(spark, docs), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, text), (5, "quite another text"), (9, "own words")]


def test_nasty_and_empty(spark):
    made, pieces = walk(spark, frame(spark, [(i, t, None if i % 3 else "en") for i, t in NASTY]))
    check_pieces(pieces, [(r.doc_id, r.text) for r in made[-1]])
    made, pieces = walk(spark, frame(spark, []))
    assert made == [[], [], [], []] and pieces == []


def test_whole_table(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids = {r.doc_id for r in got}
    assert 0.8 * len({t for _, t in texts}) < len(ids) <= len({t for _, t in texts})
